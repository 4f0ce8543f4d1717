"""Sinks: Parquet by run, CSV with header, one folder for each node, run configurations, and a cache that knows its input."""

from __future__ import annotations

import hashlib
import io
import json
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_runs(bmu: DataFrame, path: str, keys: tuple[str, ...] = ("run_id",)) -> None:
    bmu.write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_npy(bmu: DataFrame, path: str) -> None:
    """A file of pairs (node_i, node_j) in the order of t for each run, named after it: bmu has run_id, t, node_i, node_j. `path` is a
    folder that all executors share; a run_id may name folders below it ("run/BMUs")."""

    def save(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            for run, pairs in zip(b["run_id"], b["pairs"], strict=True):
                a, out = np.array([(p["node_i"], p["node_j"]) for p in pairs], np.int64).reshape(-1, 2), io.BytesIO()
                np.save(out, a)
                write_bytes(f"{path.rstrip('/')}/{run}.npy", out.getvalue())
                yield pd.DataFrame({"run_id": [run], "n": [len(a)]})

    system, place = fs.FileSystem.from_uri(path)
    system.create_dir(place, recursive=True)
    runs = bmu.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("t", "node_i", "node_j"))).alias("pairs"))
    runs.mapInPandas(save, "run_id string, n long").write.format("noop").mode("overwrite").save()


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """Small result tables: one file with a header."""
    df.coalesce(1).write.mode("append" if append else "overwrite").csv(path, header=True)


def write_bytes(path: str, content: bytes) -> None:
    system, place = fs.FileSystem.from_uri(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    with system.open_output_stream(place) as f:
        f.write(content)


def append_history(row: DataFrame, path: str) -> None:
    """Scores of a run, added to those of earlier runs."""
    row.write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def write_months_by_node(bmu: DataFrame, path: str) -> None:
    """A folder for each node, with its months in order."""
    x = bmu.filter("node_i >= 0 and node_j >= 0").select("node_i", "node_j", "year", "month").distinct()
    x.repartition("node_i", "node_j").sortWithinPartitions("node_i", "node_j", "year", "month").write.mode("overwrite").partitionBy("node_i", "node_j").csv(path, header=True)


def write_config(config: dict, folder: str) -> None:
    """A run's configuration as one file, `config.json` in the run's folder."""
    write_bytes(f"{folder.rstrip('/')}/config.json", json.dumps(config, indent=2).encode())


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir or the context's checkpoint folder; a session
    without a cluster may do with a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="fieldloom-")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to a new shared folder and read from there: what is used several times is computed once."""
    place = scratch(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


#: Leaves of a plan whose rows the plan's text does not tell.
UNTOLD = ("LocalRelation", "LogicalRDD", "ExternalRDD", "LogicalQueryStage", "InMemoryRelation")


def fingerprint(df: DataFrame) -> str:
    """What a frame is computed from: its plan, its schema, and path, length and time of every file that it reads. Files are listed, not
    read. Python functions count by their names. Rows that come from no file, or from memory besides files, are an error."""
    spark = df.sparkSession
    paths = df.inputFiles()
    with_fields = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(with_fields)
    spark.conf.set(with_fields, "100000")  # or long lists would be cut in the text
    try:
        plan = df._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set(with_fields, before)
    if not paths or any(name in plan for name in UNTOLD):
        raise ValueError("the plan does not tell all of its input; name the fingerprint")
    # numbers of columns and of lambda variables go up with every frame of a session; their order of appearance does not
    seen: dict[str, int] = {}
    plan = re.sub(r"(?:_\d+)?#(\d+)", lambda m: f"#{seen.setdefault(m[1], len(seen))}", plan)
    files = spark.read.format("binaryFile").load(paths)
    told = F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")
    n, total = files.agg(F.count("*"), F.sum(told)).first()
    return hashlib.sha256(f"{n} {total}\n{df.schema.json()}\n{plan}".encode()).hexdigest()


def cached(df: DataFrame, path: str, name: str | None = None) -> DataFrame:
    """Rows written once under a path that names their input's fingerprint (or `name`), so that a changed input is never served
    from an old file."""
    spark = df.sparkSession
    place = f"{path.rstrip('/')}/{name or fingerprint(df)}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        df.write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
