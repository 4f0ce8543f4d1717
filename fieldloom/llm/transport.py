"""Media columns: MPEG transport streams in a binary column, written and read by this module's own code.

`encode` puts a payload into one elementary stream: PES packets of at most PES_UNITS transport payloads, each
with a presentation time stamp, the first of every GROUP marked as a random-access point, behind a
programme association table and a programme map table with CRCs. `decode` trusts none of that: it parses
both tables, follows the programme's elementary stream, checks the continuity counters, reassembles the PES
packets and returns the payload with time stamps and random-access points.

Defined results: a null text is an empty one; a payload is the UTF-8 text and zero bytes up to a positive
multiple of 64 bytes; texts of any length are written packet by packet; equal texts give equal
bytes; repeated rows stay rows of their own; other columns are ignored; an empty table gives no rows. A
stream with a lost, repeated or damaged packet decodes with `continuity_errors` or `crc_errors` above
zero instead of failing; a packet that repeats the one before byte by byte is dropped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldloom.llm.common import columns, fresh_path, small_batches, utf8

# Fixed values of the transport stream format (ISO/IEC 13818-1).
PACKET, SYNC, PAT_PID, PRIVATE_PES, STREAM_PRIVATE, NULL_PID = 188, 0x47, 0x0000, 0x06, 0xBD, 0x1FFF
CRC_POLYNOMIAL = 0x04C11DB7
CLOCK = 90_000

PMT_PID, MEDIA_PID, PROGRAM = 0x1000, 0x0100, 1
PES_UNITS, GROUP, PES_SECONDS = 64, 8, 0.04
PES_HEAD = 14


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (CRC_POLYNOMIAL if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 4)).to_bytes(2, "big")
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


def _tables() -> bytes:
    pat = _section(0x00, (1).to_bytes(2, "big") + b"\xc1\0\0" + PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(0x02, PROGRAM.to_bytes(2, "big") + b"\xc1\0\0" + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_PES]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\0")
    return _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)


TABLES = _tables()


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def _unstamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def encode(payload: bytes) -> bytes:
    """The transport stream of a payload. Every PES packet is a whole number of transport packets: its
    last one is filled by the adaptation field, and its first one carries the random-access flag."""
    out, counter = [TABLES], 0
    room = PES_UNITS * 184 - PES_HEAD - 2
    for k, at in enumerate(range(0, len(payload), room)):
        part = payload[at : at + room]
        pes = b"\0\0\1" + bytes([STREAM_PRIVATE]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(int(k * PES_SECONDS * CLOCK)) + part
        head = bytes([1, 0x40 if k % GROUP == 0 else 0])
        units = -(-(len(pes) + 2) // 184)
        spare = units * 184 - len(pes) - 2
        first = 182 if units > 1 else 182 - spare
        packets = np.empty((units, PACKET), np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 255
        packets[:, 3] = 0x10 | (counter + np.arange(units)) & 15
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        counter += units
        data = np.frombuffer(pes, np.uint8)
        if units == 1:
            packets[0, 4:6] = 1 + spare, head[1]
            packets[0, 6 : 6 + spare] = 255
            packets[0, 6 + spare :] = data
        else:
            packets[0, 4:6] = head[0], head[1]
            packets[0, 6:] = data[:first]
            whole = (units - 2) * 184
            packets[1:-1, 4:] = data[first : first + whole].reshape(-1, 184)
            rest = data[first + whole :]
            if spare:
                packets[-1, 3] |= 0x20
                packets[-1, 4] = spare - 1
                if spare > 1:
                    packets[-1, 5] = 0
                packets[-1, 6 : 4 + spare] = 255
            packets[-1, 4 + spare :] = rest
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes = b""
    pid: int = -1
    packets: int = 0
    stamps: list[int] = field(default_factory=list)
    access_points: list[int] = field(default_factory=list)
    continuity_errors: int = 0
    crc_errors: int = 0
    damaged: int = 0


def _read_section(packet: bytes, table_id: int) -> bytes | None:
    at = 4 + (1 + packet[4] if packet[3] & 0x20 else 0)
    at += 1 + packet[at]
    if at + 3 > PACKET or packet[at] != table_id:
        return None
    n = 3 + ((packet[at + 1] & 0x0F) << 8 | packet[at + 2])
    section = packet[at : at + n]
    return section if len(section) == n and crc32_mpeg(section) == 0 else None


def _media_pid(media: bytes, pids: np.ndarray, units: np.ndarray, out: Stream) -> int:
    """From the programme association table to the map table to the first elementary stream."""
    pmt = -1
    for k in np.flatnonzero((pids == PAT_PID) & units):
        if (s := _read_section(media[k * PACKET : (k + 1) * PACKET], 0x00)) is None:
            out.crc_errors += 1
            continue
        for at in range(8, len(s) - 4, 4):
            if int.from_bytes(s[at : at + 2], "big"):
                pmt = int.from_bytes(s[at + 2 : at + 4], "big") & 0x1FFF
                break
    for k in np.flatnonzero((pids == pmt) & units):
        if (s := _read_section(media[k * PACKET : (k + 1) * PACKET], 0x02)) is None:
            out.crc_errors += 1
            continue
        at = 12 + (int.from_bytes(s[10:12], "big") & 0x0FFF)
        if at + 5 <= len(s) - 4:
            return int.from_bytes(s[at + 1 : at + 3], "big") & 0x1FFF
    return -1


def decode(media: bytes) -> Stream:
    out = Stream()
    n = len(media) // PACKET
    rows = np.frombuffer(media, np.uint8, n * PACKET).reshape(n, PACKET)
    good = rows[:, 0] == SYNC if n else np.zeros(0, bool)
    out.damaged = int((~good).sum()) + bool(len(media) % PACKET)
    pids = np.where(good, (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2], NULL_PID)
    units = rows[:, 1] & 0x40 > 0
    out.pid = _media_pid(media, pids, units, out)
    own = rows[(pids == out.pid)] if out.pid >= 0 else rows[:0]
    out.packets = len(own)
    if not len(own):
        return out
    has_data = own[:, 3] & 0x10 > 0
    counters = (own[:, 3] & 15).astype(np.int16)[has_data]
    steps = np.diff(counters) & 15
    repeats = np.flatnonzero((steps == 0) & (own[has_data][1:] == own[has_data][:-1]).all(axis=1)) + 1
    out.continuity_errors = int((steps != 1).sum())
    own = np.delete(own[has_data], repeats, axis=0)
    skip = np.where(own[:, 3] & 0x20 > 0, 1 + own[:, 4].astype(np.int64), 0)
    flags = np.where((own[:, 3] & 0x20 > 0) & (own[:, 4] > 0), own[:, 5], 0)
    starts = np.flatnonzero(own[:, 1] & 0x40 > 0)
    parts = []
    for k, at in enumerate(starts):
        end = starts[k + 1] if k + 1 < len(starts) else len(own)
        piece = own[at, 4 + skip[at] :].tobytes()
        if end - at > 1:
            if end - at > 2 and not skip[at + 1 : end - 1].any():
                piece += own[at + 1 : end - 1, 4:].tobytes()
            else:
                piece += b"".join(own[i, 4 + skip[i] :].tobytes() for i in range(at + 1, end - 1))
            piece += own[end - 1, 4 + skip[end - 1] :].tobytes()
        if piece[:3] != b"\0\0\1" or len(piece) < PES_HEAD:
            out.damaged += 1
            continue
        size = int.from_bytes(piece[4:6], "big")
        if piece[7] & 0x80:
            out.stamps.append(_unstamp(piece[9:14]))
        if flags[at] & 0x40:
            out.access_points.append(out.stamps[-1] if out.stamps else 0)
        parts.append(piece[9 + piece[8] : 6 + size])
        out.damaged += len(piece) != 6 + size
    out.payload = b"".join(parts)
    return out


def padded(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes(-len(text) % 64 if text else 64)


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and `media`, the transport stream of the padded text."""
    small_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns(batches, "doc_id", "text"):
            raw = utf8(texts)
            for at in range(0, len(raw), 200):
                part = raw[at : at + 200]
                yield pa.RecordBatch.from_arrays([ids[at : at + 200], pa.array([len(x or b"") for x in part], pa.int64()), pa.array([encode(padded(x)) for x in part], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(write, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def stored(docs: DataFrame) -> DataFrame:
    """The media table of `with_media`, written to the shared folder and read back from there."""
    path = fresh_path(docs.sparkSession, "media")
    with_media(docs).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def feature(s: Stream) -> str:
    """Stream identity, packets, PES packets, last time stamp, random-access points and faults."""
    return f"pid={s.pid};packets={s.packets};pes={len(s.stamps)};last_pts={s.stamps[-1] if s.stamps else -1};access={','.join(map(str, s.access_points))};continuity={s.continuity_errors};crc={s.crc_errors};damaged={s.damaged}"


def read_media(media: DataFrame) -> DataFrame:
    """Demultiplexes the `media` column: payload, time stamps, random-access points, faults."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, blobs in columns(batches, "doc_id", "n_bytes", "media"):
            found = [decode(x.as_buffer().to_pybytes()) for x in blobs]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "time_stamps", "access_points"]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    sizes,
                    pa.array([len(s.payload) for s in found], pa.int64()),
                    pa.array([hashlib.sha256(s.payload).hexdigest() for s in found]),
                    pa.array([zlib.crc32(s.payload[-64:]) for s in found], pa.int64()),
                    pa.array([len(x.as_buffer()) for x in blobs], pa.int64()),
                    pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in blobs]),
                    pa.array([feature(s) for s in found]),
                    pa.array([s.stamps for s in found], pa.list_(pa.int64())),
                    pa.array([s.access_points for s in found], pa.list_(pa.int64())),
                ],
                names,
            )

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, time_stamps array<long>, access_points array<long>")
