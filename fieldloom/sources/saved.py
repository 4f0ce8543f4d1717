"""Trained runs as files: which of them are there, complete and described, and what their arrays assign.

Two layouts are known: a folder for each run that holds `BMUs.npy` and `config.json`, and folders of arrays whose names tell map
and seed. A listing reads no array: path, length and time come from the store, and give a run's fingerprint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.sources import files

ARRAY, CONFIG = "BMUs.npy", "config.json"
#: Columns of a listing.
LISTED = ("run_id", "path", "fingerprint", "rows", "columns", "initialization", "training_metric", "seed")


def _files(spark: SparkSession, roots: list[str], glob: str) -> DataFrame:
    """path, folder, name and the state of each file; folders that do not exist are skipped."""
    found = files.present_folders(spark, roots)
    if not found:
        return spark.range(0).select(*(F.lit("").alias(c) for c in ("path", "folder", "name", "state")))
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(found)
    path = F.col("_metadata.file_path")
    state = F.concat_ws(" ", path, "length", F.col("modificationTime").cast("double"))
    return x.select(path.alias("path"), F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("folder"), F.substring_index(path, "/", -1).alias("name"), state.alias("state"))


def in_folders(spark: SparkSession, *roots: str) -> DataFrame:
    """Runs of the first layout, named after their folders' paths. A folder without both files is not there yet; a configuration that tells no
    size of the map leaves rows and columns null."""
    both = _files(spark, list(roots), f"{{{ARRAY},{CONFIG}}}").groupBy("folder")
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("path")))
    complete = both.agg(pick(ARRAY).alias("path"), pick(CONFIG).alias("config"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("state"))), 256).alias("fingerprint"))
    complete = complete.filter("path is not null and config is not null").drop("config")
    found = files.present_folders(spark, list(roots))
    if not found:
        return complete.select(F.col("folder").alias("run_id"), "path", "fingerprint", *(F.lit(None).cast(t).alias(c) for c, t in zip(LISTED[3:], ("int", "int", "string", "string", "int"), strict=True)))
    described = files.read_configs(spark, found, "folder")
    size = lambda k: F.get("grid_size", F.lit(k))
    x = complete.join(described, "folder", "left")
    return x.select(F.col("folder").alias("run_id"), "path", "fingerprint", size(0).alias("rows"), size(1).alias("columns"), "initialization", F.col("bmu_metric").alias("training_metric"), "seed")


def by_name(spark: SparkSession, root: str, configurations: dict[str, tuple[str, str]]) -> DataFrame:
    """Runs of the second layout: for each folder below root its training metric and initialization; arrays whose names do not tell map and
    seed are no runs."""
    x = files.name_parts(_files(spark, [f"{root.rstrip('/')}/{c}" for c in configurations], "*.npy"), "name").filter("grid is not null")
    side = F.split("grid", "x")
    last = F.substring_index("folder", "/", -1)
    told = lambda k: F.coalesce(*(F.when(last == c, v[k]) for c, v in configurations.items())) if configurations else F.lit("")
    return x.select(
        F.concat_ws("/", "folder", F.regexp_replace("name", r"\.npy$", "")).alias("run_id"), "path", F.sha2("state", 256).alias("fingerprint"),
        F.get(side, F.lit(0)).cast("int").alias("rows"), F.get(side, F.lit(1)).cast("int").alias("columns"), told(1).alias("initialization"), told(0).alias("training_metric"), "seed",
    )


def assignments(spark: SparkSession, listed: DataFrame, paths: list[str]) -> DataFrame:
    """run_id, t, node of the arrays at `paths`, of pairs or flat labels; negative ones are unassigned (-1)."""
    at = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path"), "content")
    x = files.npy_rows(at).join(listed.select("path", "run_id", "columns"), "path")
    first, second = F.get("row", F.lit(0)), F.get("row", F.lit(1))
    node = F.when(F.size("row") == 2, F.when((first >= 0) & (second >= 0), first * F.col("columns") + second)).otherwise(F.when(first >= 0, first))
    return x.select("run_id", F.col("i").alias("t"), F.coalesce(node, F.lit(-1)).cast("int").alias("node"))
