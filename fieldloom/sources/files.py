"""Files that the pipeline exchanges: NPY arrays, NetCDF classic cubes, JSON configurations, CSV tables, and what
directory and file names say. Bytes are read by Spark (binaryFile), so any store that Spark knows will do. Of pickled arrays
only plain ones are read: nothing but arrays, numbers and containers can be in them, whatever the file says."""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.sources import gridded
from fieldloom.sources.gridded import AUXILIARY, DIMENSIONS, detect_variable, resolve  # noqa: F401  (names of this module, too)

ENSO_SCHEMA = "season_year int, label_year int, oni double, phase string"
BMU_SCHEMA = "fecha timestamp_ntz, nodo_i int, nodo_j int, nodo int"


class _PlainArrays(pickle.Unpickler):
    """Unpickles arrays of numbers and of arrays; any other class or function in the file is an error."""

    # The names under which pickled arrays refer to their own parts.
    ALLOWED = frozenset((f"numpy{core}.multiarray", name) for core in (".core", "._core") for name in ("_reconstruct", "scalar")) | {("numpy", "ndarray"), ("numpy", "dtype"), ("_codecs", "encode")}

    def find_class(self, module: str, name: str):
        if (module, name) not in self.ALLOWED:
            raise pickle.UnpicklingError(f"{module}.{name} is no part of a plain array")
        return super().find_class(module, name)


def plain_array(content: bytes) -> np.ndarray:
    """An NPY file's array, pickled or not."""
    f = io.BytesIO(content)
    version = np.lib.format.read_magic(f)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
    if read is None:
        raise ValueError(f"NPY version {version}")
    shape, _, dtype = read(f)
    return _PlainArrays(f).load().reshape(shape) if dtype.hasobject else np.load(io.BytesIO(content), allow_pickle=False)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, iy, ix of saved index pairs (rows and columns of the valid cells, in their order)."""

    def parse(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                iy, ix = (np.asarray(a, np.int64) for a in plain_array(bytes(content)))
                yield pd.DataFrame({"path": p, "pos": np.arange(len(iy)), "iy": iy, "ix": ix})

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInPandas(parse, "path string, pos int, iy int, ix int")


def read_npy(spark: SparkSession, path: str, glob: str = "*.npy") -> DataFrame:
    """path, i, row: each array's first axis as rows of doubles (a flat array gives rows of one)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return npy_rows(files.select("path", "content"))


def npy_rows(files: DataFrame) -> DataFrame:
    """The rows of read_npy from files (path, content)."""

    def parse(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                a = plain_array(bytes(content))
                a = a.reshape(len(a), -1).astype(float)
                yield pd.DataFrame({"path": p, "i": np.arange(len(a)), "row": list(a)})

    return files.mapInPandas(parse, "path string, i long, row array<double>")


def read_bmus(spark: SparkSession, path: str, columns: int | None = None) -> DataFrame:
    """path, t, node_i, node_j from arrays of pairs, or of flat labels when the number of columns is given."""
    x = read_npy(spark, path)
    pair = F.size("row") == 2
    i = F.when(pair, F.get("row", F.lit(0))).otherwise(F.floor(F.get("row", F.lit(0)) / F.lit(columns or 1)))
    j = F.when(pair, F.get("row", F.lit(1))).otherwise(F.get("row", F.lit(0)) % F.lit(columns or 1))
    if columns is None:
        x = x.filter(F.when(pair, True).otherwise(F.raise_error("flat labels need the number of columns")))
    return x.select("path", F.col("i").alias("t"), i.cast("int").alias("node_i"), j.cast("int").alias("node_j"))


def read_cube(spark: SparkSession, path: str, variable: str | None = None, policy: str = "strict", months: str | None = None) -> DataFrame:
    """t, time, year, month, iy, ix, lat, lon, value of NetCDF classic files, read slab by slab; NaN and fill values become null."""
    return gridded.scan(spark, path, variable=variable, policy=policy, months=months)


def read_times(spark: SparkSession, path: str) -> DataFrame:
    """t, time, year, month: the time axis of NetCDF classic files; nothing but header and axis is read."""
    return gridded.scan(spark, path, "t long, time timestamp_ntz, year int, month int")


def read_configs(spark: SparkSession, path: str | list[str], folder: str | None = None) -> DataFrame:
    """Run configurations, of all folders below the path as well; the map's size under either of its keys. folder: a column for the
    path of the folder that holds the file."""
    schema = "grid_size array<int>, grid array<int>, initialization string, bmu_metric string, epochs int, seed int, learning_rate double"
    x = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").schema(schema).json(path)
    own = [F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1).alias(folder)] if folder else []
    return x.select(*own, F.coalesce("grid_size", "grid").alias("grid_size"), "initialization", "bmu_metric", "epochs", "seed", "learning_rate")


def read_enso(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENSO_SCHEMA).csv(path, header=True, encoding="UTF-8")


def read_bmu_dates(spark: SparkSession, path: str) -> DataFrame:
    """The table of assignments by date, with year, month and the engine's own names."""
    x = spark.read.schema(BMU_SCHEMA).csv(path, header=True)
    return x.select("fecha", F.year("fecha").alias("year"), F.month("fecha").alias("month"), F.col("nodo_i").alias("node_i"), F.col("nodo_j").alias("node_j"), F.col("nodo").alias("node"))


def name_parts(df: DataFrame, column: str) -> DataFrame:
    """grid and seed of a file name; null unless both are there."""
    grid, seed = F.regexp_extract(column, r"_(\d+x\d+)_", 1), F.regexp_extract(column, r"seed(\d+)", 1)
    both = (grid != "") & (seed != "")
    return df.withColumn("grid", F.when(both, grid)).withColumn("seed", F.when(both, seed).try_cast("int"))


def complete_directories(files: DataFrame, required: tuple[str, ...], column: str = "path") -> DataFrame:
    """Directories that hold all of the required files, in order."""
    name = F.substring_index(column, "/", -1)
    folder = F.expr(f"substring({column}, 1, length({column}) - length(substring_index({column}, '/', -1)) - 1)")
    x = files.select(folder.alias("directory"), name.alias("name")).filter(F.col("name").isin(*required))
    return x.groupBy("directory").agg(F.count_distinct("name").alias("n")).filter(F.col("n") == len(required)).select("directory")


def present_folders(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the folders that exist; the others are skipped."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return [p for p in paths if path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(p))]


def missing(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(present.select(*keys).distinct(), keys, "left_anti")
