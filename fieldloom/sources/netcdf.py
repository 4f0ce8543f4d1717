"""NetCDF classic files (CDF-1, CDF-2 and CDF-5) in plain Python: enough to read and write gridded cubes. Files of the
HDF5 kind need a library that is not at hand; the engine's own format is Parquet."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import numpy as np

# Fixed values of the format.
DIMENSION, VARIABLE, ATTRIBUTE = 0x0A, 0x0B, 0x0C
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
CODES = {"i1": 1, "i2": 3, "i4": 4, "f4": 5, "f8": 6}


@dataclass
class Variable:
    dimensions: tuple[str, ...]
    values: np.ndarray
    attributes: dict = field(default_factory=dict)


@dataclass
class File:
    dimensions: dict[str, int]
    variables: dict[str, Variable]
    attributes: dict = field(default_factory=dict)


class _Reader:
    def __init__(self, data: bytes):
        if data[:3] != b"CDF" or len(data) < 4 or data[3] not in (1, 2, 5):
            raise ValueError("not a NetCDF classic file")
        self.data, self.at, self.version = data, 4, data[3]

    def number(self, size: int = 4) -> int:
        self.at += size
        if self.at > len(self.data):
            raise EOFError
        return int.from_bytes(self.data[self.at - size : self.at], "big")

    def count(self) -> int:
        return self.number(8 if self.version == 5 else 4)

    def padded(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        self.at += -(-n // 4) * 4
        if len(out) < n:
            raise EOFError
        return out

    def name(self) -> str:
        return self.padded(self.count()).decode()

    def attributes(self) -> dict:
        kind, n = self.number(), self.count()
        out = {}
        for _ in range(n if kind == ATTRIBUTE else 0):
            name, code, size = self.name(), self.number(), self.count()
            dtype = np.dtype(TYPES[code])
            raw = self.padded(size * dtype.itemsize)
            out[name] = raw.decode(errors="replace") if code == 2 else (v := np.frombuffer(raw, dtype))[0] if size == 1 else v
        return out


@dataclass
class Placed:
    """A variable as the header has it: where its values begin, and how far apart records are."""

    dimensions: tuple[str, ...]
    dtype: np.dtype
    begin: int
    is_record: bool
    attributes: dict


@dataclass
class Head:
    dimensions: dict[str, int]
    variables: dict[str, Placed]
    attributes: dict
    stride: int

    def shape(self, name: str) -> tuple[int, ...]:
        return tuple(self.dimensions[d] for d in self.variables[name].dimensions)

    def slab(self, read, name: str, k: int) -> np.ndarray:
        """The values at place k of the first dimension; read(offset, size) gives bytes."""
        v, shape = self.variables[name], self.shape(name)[1:]
        size = int(np.prod(shape, dtype=np.int64)) * v.dtype.itemsize
        return np.frombuffer(read(v.begin + k * (self.stride if v.is_record else size), size), v.dtype).reshape(shape)

    def values(self, read, name: str) -> np.ndarray:
        v, shape = self.variables[name], self.shape(name)
        if v.is_record:
            values = np.stack([self.slab(read, name, k) for k in range(shape[0])]) if shape[0] else np.zeros(shape, v.dtype)
        else:
            values = np.frombuffer(read(v.begin, int(np.prod(shape, dtype=np.int64)) * v.dtype.itemsize), v.dtype).reshape(shape)
        return values if v.dtype.kind == "S" else values.astype(v.dtype.newbyteorder("="))


def head(data: bytes) -> Head:
    """The header, from the file's first bytes; EOFError if it goes on."""
    r = _Reader(data)
    records = r.count()
    dims: list[tuple[str, int]] = []
    kind, n = r.number(), r.count()
    for _ in range(n if kind == DIMENSION else 0):
        dims.append((r.name(), r.count()))
    attributes = r.attributes()
    kind, n = r.number(), r.count()
    variables, items = {}, []
    for _ in range(n if kind == VARIABLE else 0):
        name, rank = r.name(), r.count()
        ids = [r.count() for _ in range(rank)]
        own, dtype = r.attributes(), np.dtype(TYPES[r.number()])
        r.count()
        is_record = bool(ids) and dims[ids[0]][1] == 0
        variables[name] = Placed(tuple(dims[i][0] for i in ids), dtype, r.number(4 if r.version == 1 else 8), is_record, own)
        if is_record:
            items.append(int(np.prod([dims[i][1] for i in ids[1:]], dtype=np.int64)) * dtype.itemsize)
    stride = sum(-(-v // 4) * 4 for v in items) if len(items) > 1 else sum(items)
    return Head({k: v or records for k, v in dims}, variables, attributes, stride)


def read(data: bytes) -> File:
    found = head(data)
    at = lambda begin, size: data[begin : begin + size]
    return File(found.dimensions, {k: Variable(v.dimensions, found.values(at, k), v.attributes) for k, v in found.variables.items()}, found.attributes)


def head_bytes(dimensions: dict[str, int], variables: dict[str, Variable], larger: dict[str, tuple] | None = None, own: dict | None = None) -> tuple[bytes, int]:
    """A CDF-2 header without a record dimension with the values of `variables`, and the offset at which those of `larger` begin: variables (dimensions, shape,
    type, attributes) that are written apart."""
    number = lambda x: struct.pack(">I", x)

    def text(s: str) -> bytes:
        raw = s.encode()
        return number(len(raw)) + raw + bytes(-len(raw) % 4)

    def attributes(d: dict) -> bytes:
        if not d:
            return number(0) * 2
        out = number(ATTRIBUTE) + number(len(d))
        for k, v in d.items():
            raw, code = (v.encode(), 2) if isinstance(v, str) else (np.asarray(v, ">f8").tobytes(), 6)
            size = len(raw) if code == 2 else len(raw) // 8
            out += text(k) + number(code) + number(size) + raw + bytes(-len(raw) % 4)
        return out

    names = list(dimensions)
    body = [v.values.astype(v.values.dtype.newbyteorder(">")).tobytes() for v in variables.values()]
    body = [b + bytes(-len(b) % 4) for b in body]
    entries = [(k, v.dimensions, v.attributes, v.values.dtype, len(raw)) for (k, v), raw in zip(variables.items(), body, strict=True)]
    for k, (own_dimensions, shape, dtype, own_attributes) in (larger or {}).items():
        size = int(np.prod(shape, dtype=np.int64)) * np.dtype(dtype).itemsize
        entries.append((k, own_dimensions, own_attributes, np.dtype(dtype), -(-size // 4) * 4))
    top = b"CDF\x02" + number(0) + number(DIMENSION) + number(len(names)) + b"".join(text(n) + number(dimensions[n]) for n in names) + attributes(own or {})

    def table(start: int) -> bytes:
        out = number(VARIABLE) + number(len(entries))
        for name, used, said, dtype, size in entries:
            code = CODES[dtype.str[1:]]
            # sizes that the field cannot hold are said to be as large as it can
            out += text(name) + number(len(used)) + b"".join(number(names.index(d)) for d in used) + attributes(said) + number(code) + number(min(size, 2**32 - 1)) + struct.pack(">Q", start)
            start += size
        return out

    start = len(top) + len(table(0))
    return top + table(start) + b"".join(body), start + sum(map(len, body))


def write(f: File) -> bytes:
    """A CDF-2 file without a record dimension."""
    return head_bytes(f.dimensions, f.variables, own=f.attributes)[0]


def dates(v: Variable) -> list[datetime]:
    """Times of a "<units> since <date>" axis; months count as calendar months."""
    unit, _, origin = str(v.attributes.get("units", "days since 1970-01-01")).partition(" since ")
    base = datetime.fromisoformat(origin.strip().replace("T", " ")[:19])
    out = []
    for x in v.values.astype(float):
        if unit.startswith("month"):
            m = base.year * 12 + base.month - 1 + int(x)
            out.append(datetime(m // 12, m % 12 + 1, base.day))
        else:
            out.append(base + timedelta(**{unit.strip() if unit.strip().endswith("s") else unit.strip() + "s": x}))
    return out
