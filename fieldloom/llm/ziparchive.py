"""ZIP files by this module's own reader and writer: members are stored, never packed, so that a byte range of a member
is a byte range of the archive. ZIP64 records are written where a size, an offset or a count needs them (or on
demand) and always understood."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

# Fixed values of the format.
LOCAL, CENTRAL, END, END64, LOCATOR64, EXTRA64, DESCRIPTOR_FLAG, STORED = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 0x0001, 0x0008, 0
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF
END_SIZE, LOCATOR_SIZE, LONGEST_COMMENT = 22, 20, 65535


class ZipError(ValueError):
    pass


@dataclass
class Member:
    name: str
    size: int
    crc: int
    header_at: int
    method: int = STORED
    data_at: int = -1


class ZipWriter:
    """Writes stored members in one pass to a sink with write(bytes)."""

    def __init__(self, write: Callable[[bytes], object], zip64: bool = False):
        self.write, self.zip64, self.at, self.members = write, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        member = Member(name, len(data), zlib.crc32(data), self.at)
        raw = name.encode()
        big = self.zip64 or member.size >= FULL32
        extra = struct.pack("<HHQQ", EXTRA64, 16, member.size, member.size) if big else b""
        size = FULL32 if big else member.size
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45 if big else 20, 0x0800, STORED, 0, 0x21, member.crc, size, size, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.members.append(member)

    def close(self) -> None:
        start = self.at
        for m in self.members:
            raw = m.name.encode()
            big = self.zip64 or m.size >= FULL32 or m.header_at >= FULL32
            extra = struct.pack("<HHQQQ", EXTRA64, 24, m.size, m.size, m.header_at) if big else b""
            size, at = (FULL32, FULL32) if big else (m.size, m.header_at)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if big else 20, 0x0800, STORED, 0, 0x21, m.crc, size, size, len(raw), len(extra), 0, 0, 0, 0, at) + raw + extra)
        length, n = self.at - start, len(self.members)
        if self.zip64 or n >= FULL16 or start >= FULL32 or length >= FULL32:
            at = self.at
            self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, length, start))
            self._put(struct.pack("<IIQI", LOCATOR64, 0, at, 1))
            n, length, start = FULL16, FULL32, FULL32
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, n, n, length, start, 0))


class ZipReader:
    """Reads directories and ranges through read(offset, size); never a whole archive."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        tail_at = max(0, size - END_SIZE - LONGEST_COMMENT)
        tail = read(tail_at, size - tail_at)
        k = tail.rfind(struct.pack("<I", END))
        while k >= 0 and (k + END_SIZE > len(tail) or k + END_SIZE + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
            k = tail.rfind(struct.pack("<I", END), 0, k)
        if k < 0:
            raise ZipError("no end of central directory")
        _, _, _, n, length, start = struct.unpack_from("<HHHHII", tail, k + 4)
        if n == FULL16 or length == FULL32 or start == FULL32:
            if tail_at + k < LOCATOR_SIZE:
                raise ZipError("no ZIP64 locator")
            mark, _, at, _ = struct.unpack("<IIQI", read(tail_at + k - LOCATOR_SIZE, LOCATOR_SIZE))
            if mark != LOCATOR64:
                raise ZipError("no ZIP64 locator")
            end = struct.unpack("<IQHHIIQQQQ", read(at, 56))
            if end[0] != END64:
                raise ZipError("no ZIP64 end of central directory")
            n, length, start = end[7], end[8], end[9]
        self.members: dict[str, Member] = {}
        directory, at = read(start, length), 0
        for _ in range(n):
            mark, _, _, flags, method, _, _, crc, packed, plain, names, extras, comments, _, _, _, offset = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
            if mark != CENTRAL:
                raise ZipError("damaged central directory")
            name = directory[at + 46 : at + 46 + names].decode()
            extra = directory[at + 46 + names : at + 46 + names + extras]
            plain, packed, offset = self._wide(extra, plain, packed, offset)
            self.members[name] = Member(name, packed, crc, offset, method)
            at += 46 + names + extras + comments

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """Replaces saturated fields by those of the ZIP64 extra field, in the order plain, packed, offset."""
        out, at = list(values), 0
        while at + 4 <= len(extra):
            kind, size = struct.unpack_from("<HH", extra, at)
            if kind == EXTRA64:
                place = at + 4
                for k, v in enumerate(values):
                    if v == FULL32 and place + 8 <= at + 4 + size:
                        out[k] = struct.unpack_from("<Q", extra, place)[0]
                        place += 8
            at += 4 + size
        return out

    def start_of(self, m: Member) -> int:
        if m.data_at < 0:
            if m.method != STORED:
                raise ZipError(f"{m.name} is packed; ranges need stored members")
            head = self.read(m.header_at, 30)
            if struct.unpack_from("<I", head)[0] != LOCAL:
                raise ZipError(f"no local header of {m.name}")
            names, extras = struct.unpack_from("<HH", head, 26)
            m.data_at = m.header_at + 30 + names + extras
        return m.data_at

    def range(self, name: str, offset: int, size: int) -> bytes:
        m = self.members[name]
        if offset < 0 or offset + size > m.size:
            raise ZipError(f"range beyond {name}")
        return self.read(self.start_of(m) + offset, size)

    def whole(self, name: str) -> bytes:
        data = self.range(name, 0, self.members[name].size)
        if zlib.crc32(data) != self.members[name].crc:
            raise ZipError(f"checksum of {name}")
        return data
