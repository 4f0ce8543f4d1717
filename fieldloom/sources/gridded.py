"""Gridded NetCDF files as a partitioned source and sink.

The source (`spark.read.format("fieldloom_netcdf")`) plans from headers alone: each partition is a run of slabs along the variable's first
dimension, of SLAB_BYTES at most, which its task reads by range; files may be of any size. Columns that the given schema does not name cost nothing: without
`value` only the header and the axes are read. The option `months` ("10,11,12,1,2,3") leaves out the slabs of other months
where time is the first dimension. NaN and fill values are null.

The sink writes one file in parallel: the header says where each value goes, so each task writes its slabs at their offsets (`file:` paths, in a folder that all
executors share), or, in stores without such writes, as objects that are joined in order afterwards. No task holds more than a slab.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from fieldloom.sources import netcdf

SLAB_BYTES = 8 << 20
HEAD_BYTES = 1 << 16
SCHEMA = "t long, time timestamp_ntz, year int, month int, iy int, ix int, lat double, lon double, value double"
DIMENSIONS = {"time": ("time", "valid_time", "t"), "latitude": ("latitude", "lat", "y"), "longitude": ("longitude", "lon", "x")}
#: Coordinates and bounds, which are never the variable of a cube.
AUXILIARY = frozenset("time_bnds latitude_bnds longitude_bnds lat_bnds lon_bnds crs spatial_ref time latitude longitude lat lon".split())


def detect_variable(names: list[str], policy: str = "strict") -> str:
    """The one variable that is not auxiliary; policy "first" takes the first instead of insisting on one."""
    found = [n for n in names if n not in AUXILIARY]
    if not found or policy == "strict" and len(found) > 1:
        raise ValueError(f"expected one variable, found {found or 'none'}")
    return found[0]


def resolve(names: list[str], wanted: str) -> str | None:
    return next((a for a in DIMENSIONS[wanted] if a in names), None)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


class Ranges:
    """A file read by ranges; counts the bytes."""

    def __init__(self, path: str):
        system, name = opened(path)
        self.file, self.bytes_read = system.open_input_file(name), 0

    def __call__(self, at: int, size: int) -> bytes:
        out = self.file.read_at(size, at)
        self.bytes_read += len(out)
        return out

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def head_of(read: Ranges) -> netcdf.Head:
    size = HEAD_BYTES
    while True:
        data = read(0, size)
        try:
            return netcdf.head(data)
        except EOFError:
            if len(data) < size:
                raise ValueError("the file ends inside its header") from None
            size *= 4


@dataclass
class Layout:
    """What a file's header says about its cube."""

    head: netcdf.Head
    name: str | None
    axes: list[str]

    @classmethod
    def of(cls, head: netcdf.Head, variable: str | None, policy: str, values: bool) -> Layout:
        names = list(head.variables)
        axes = [resolve(names, d) for d in DIMENSIONS]
        name = variable or detect_variable([n for n in names if n not in head.dimensions], policy) if values else None
        if axes[0] is None or values and (name not in names or None in axes):
            raise ValueError(f"needs {name or 'a time axis'} over time, latitude and longitude; has {names}")
        return cls(head, name, axes)

    def axis(self, read: Ranges, k: int) -> np.ndarray:
        return self.head.values(read, self.axes[k])

    def times(self, read: Ranges) -> list:
        v = self.head.variables[self.axes[0]]
        return netcdf.dates(netcdf.Variable(v.dimensions, self.axis(read, 0), v.attributes))


@dataclass
class Slabs(InputPartition):
    path: str
    first: int
    last: int


class CubeSource(DataSource):
    """Classic NetCDF files as rows of cells."""

    @classmethod
    def name(cls) -> str:
        return "fieldloom_netcdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CubeReader:
        return CubeReader(self.options, schema.names)


class CubeReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.paths = files_of(options["path"])
        self.variable, self.policy = options.get("variable"), options.get("policy", "strict")
        self.months = frozenset(int(m) for m in options["months"].split(",")) if options.get("months") else None
        self.slab_bytes = int(options.get("slabBytes", SLAB_BYTES))
        self.columns = columns
        #: Without a column of cells, rows are times.
        self.cells = not {"iy", "ix", "lat", "lon", "value"}.isdisjoint(columns)

    def partitions(self) -> list[Slabs]:
        out = []
        for path in self.paths:
            with Ranges(path) as read:
                layout = Layout.of(head_of(read), self.variable, self.policy, self.cells)
                if not self.cells:
                    out.append(Slabs(path, 0, layout.head.shape(layout.axes[0])[0]))
                    continue
                shape = layout.head.shape(layout.name)
                step = max(1, self.slab_bytes // max(1, 8 * int(np.prod(shape[1:]))))
                out += [Slabs(path, k, min(k + step, shape[0])) for k in range(0, shape[0], step)]
        return out or [Slabs("", 0, 0)]

    def read(self, partition: Slabs) -> Iterator[pa.RecordBatch]:
        if partition.path:
            with Ranges(partition.path) as read:
                yield from self.rows(read, partition.first, partition.last)

    def rows(self, read: Ranges, first: int, last: int) -> Iterator[pa.RecordBatch]:
        layout = Layout.of(head_of(read), self.variable, self.policy, self.cells)
        times = layout.times(read)
        wanted = lambda t: self.months is None or times[t].month in self.months
        if not self.cells:
            yield self.batch(times, np.array([t for t in range(first, last) if wanted(t)], np.int64))
            return
        v = layout.head.variables[layout.name]
        order = [v.dimensions.index(a) for a in layout.axes]
        lat, lon = (layout.axis(read, k).astype(float) for k in (1, 2))
        fill = v.attributes.get("_FillValue")
        for k in range(first, last):
            if order[0] == 0 and not wanted(k):
                continue
            shape = list(layout.head.shape(layout.name))
            shape[0] = 1
            values = None
            if "value" in self.columns:
                values = layout.head.slab(read, layout.name, k).astype(float).ravel()
                values[values == fill] = np.nan
            index = [x.ravel() for x in np.indices(shape)]
            index[0] = index[0] + k
            t, iy, ix = (index[o] for o in order)
            if order[0] and self.months is not None:
                kept = np.isin(t, [j for j in range(len(times)) if wanted(j)])
                t, iy, ix, values = t[kept], iy[kept], ix[kept], None if values is None else values[kept]
            yield self.batch(times, t, iy, ix, lat, lon, values)

    def batch(self, times: list, t: np.ndarray, iy=None, ix=None, lat=None, lon=None, values=None) -> pa.RecordBatch:
        of = lambda make, kind: pa.array(np.array([make(w) for w in times])[t] if len(t) else [], kind)
        made = {
            "t": lambda: pa.array(t, pa.int64()), "time": lambda: of(lambda w: np.datetime64(w, "us"), pa.timestamp("us")), "year": lambda: of(lambda w: w.year, pa.int32()),
            "month": lambda: of(lambda w: w.month, pa.int32()), "iy": lambda: pa.array(iy, pa.int32()), "ix": lambda: pa.array(ix, pa.int32()),
            "lat": lambda: pa.array(lat[iy]), "lon": lambda: pa.array(lon[ix]), "value": lambda: pa.array(values, pa.float64(), mask=np.isnan(values)),
        }
        return pa.RecordBatch.from_arrays([made[c]() for c in self.columns], names=self.columns)


def files_of(path: str) -> list[str]:
    """A file, or the files of a folder in the order of their names."""
    system, name = opened(path)
    if system.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    found = system.get_file_info(fs.FileSelector(name))
    return [f"{path.rstrip('/')}/{f.base_name}" for f in sorted(found, key=lambda f: f.base_name) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]


def scan(spark: SparkSession, path: str, columns: str = SCHEMA, **options) -> DataFrame:
    """Rows of the columns of `columns`, a part of SCHEMA."""
    spark.dataSource.register(CubeSource)
    reader = spark.read.format(CubeSource.name()).schema(columns)
    for name, value in options.items():
        if value is not None:
            reader = reader.option(name, str(value))
    return reader.load(path)


def write_cube(cells: DataFrame, path: str, coordinates: dict[str, netcdf.Variable], variable: str = "value", order: tuple[str, str, str] = ("t", "iy", "ix"),
               slab_bytes: int = SLAB_BYTES, attributes: dict | None = None, by_offset: bool | None = None) -> None:
    """One classic file from cells (t, iy, ix, value): cells that are missing or null are NaN, of cells given twice one stays. `coordinates` are
    the file's small variables, the three axes in the order of `order` first; `order` names the cube's dimensions from the outside in."""
    names = list(coordinates)[:3]
    shape = [len(coordinates[n].values) for n in names]
    dimensions = {n: k for v in coordinates.values() for n, k in zip(v.dimensions, v.values.shape, strict=True)}
    head, begin = netcdf.head_bytes(dimensions, coordinates, {variable: (tuple(names), shape, ">f8", attributes or {})})
    inner = shape[1] * shape[2]
    step = max(1, slab_bytes // max(1, 8 * inner))
    system, name = opened(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    by_offset = isinstance(system, fs.LocalFileSystem) if by_offset is None else by_offset
    parts = f"{path}.parts"
    if by_offset:
        with open(name, "wb") as out:
            out.write(head)
            out.truncate(begin + 8 * inner * shape[0])
    else:
        opened(parts)[0].create_dir(opened(parts)[1], recursive=True)
    n_slabs = -(-shape[0] // step)

    def put(slab: int, values: np.ndarray) -> None:
        raw = values.astype(">f8").tobytes()
        if by_offset:
            with open(name, "r+b") as out:
                out.seek(begin + 8 * inner * step * slab)
                out.write(raw)
        else:
            place, part = opened(f"{parts}/{slab:08d}")
            with place.open_output_stream(part) as out:
                out.write(raw)

    def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, values, done = None, None, 0
        for batch in batches:
            slab, at, value = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("slab", "at", "value"))
            for s in np.unique(slab):
                if s != now:
                    if now is not None:
                        put(now, values)
                        done += 1
                    now, values = int(s), np.full(inner * (min(step, shape[0] - int(s) * step)), np.nan)
                own = (slab == s) & (at >= 0)
                values[at[own]] = value[own]
        if now is not None:
            put(now, values)
            done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    outer, middle, last = (F.col(c).cast("long") for c in order)
    slab = F.floor(outer / step).cast("long")
    rows = cells.select(slab.alias("slab"), (((outer - slab * step) * shape[1] + middle) * shape[2] + last).cast("long").alias("at"), F.col("value").cast("double").alias("value"))
    rows = rows.filter("value is not null")
    # A row without a place for each slab, so that those without any cell are written, too.
    every = cells.sparkSession.range(n_slabs).select(F.col("id").alias("slab"), F.lit(-1).cast("long").alias("at"), F.lit(None).cast("double").alias("value"))
    dealt = rows.unionByName(every).repartition(n_slabs if n_slabs < 1000 else 1000, "slab").sortWithinPartitions("slab", "at", "value")
    written = dealt.mapInArrow(slabs, "n long").agg(F.sum("n")).first()[0] or 0
    if written != n_slabs:
        raise RuntimeError(f"{written} of {n_slabs} slabs were written")
    if not by_offset:
        with system.open_output_stream(name) as out:
            out.write(head)
            for k in range(n_slabs):
                place, part = opened(f"{parts}/{k:08d}")
                with place.open_input_stream(part) as source:
                    while piece := source.read(1 << 20):
                        out.write(piece)
