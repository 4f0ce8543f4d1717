"""Evaluation of saved runs that goes on where it stopped.

The ledger is a Parquet folder with one row for each evaluated run: its record, the fingerprint of its files and that of the fields. A call
lists the runs (fieldloom.sources.saved), leaves out those that the ledger knows under both fingerprints, and computes the others in groups;
a group's records are appended in one job, so a call that is cut off loses a group at most and the next one goes on. A run whose files or
fields have changed is evaluated again; its older record stays in the ledger but is no longer returned.

Defined results: a run without a map's size, or with another number of assignments than there are fields, has a record with null indices and
a note, and is not looked at again until its files change; no runs give no records; two calls at the same time may write a record twice, it is
returned once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.operators import runs
from fieldloom.sources import files, saved, sinks

#: Runs that are evaluated in one job: the fields' distances are computed once for each group.
GROUP = 1_000
INDEX_COLUMNS = ("n_nodes_total int", "n_nodes_empty int", "max_node_share double", "occupancy_entropy double", "n_clusters_occupied int", *(f"{c} double" for c in runs.INDICES), "note string")
SCHEMA = ", ".join(("run_id string", "fingerprint string", "of_fields string", "phase string", "grid string", "initialization string", "training_metric string", "seed int", *INDEX_COLUMNS))
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
KEYS = ["run_id", "fingerprint", "of_fields"]


def read(spark: SparkSession, ledger: str) -> DataFrame:
    there = files.present_folders(spark, [ledger])
    return spark.read.schema(SCHEMA).parquet(ledger) if there else spark.createDataFrame([], SCHEMA)


def evaluate(fields: DataFrame, listed: DataFrame, ledger: str, phase: str, of_fields: str | None = None, group: int = GROUP) -> DataFrame:
    """The records of all listed runs. fields: t, vec; an array's k-th assignment is that of the k-th field by t. of_fields: the fields'
    fingerprint, where it cannot be told from their files."""
    spark = fields.sparkSession
    of_fields = of_fields or sinks.fingerprint(fields)
    listed = sinks.written(listed.withColumn("of_fields", F.lit(of_fields)), "listing")
    new = listed.join(read(spark, ledger).select(*KEYS), KEYS, "left_anti")
    # names of new runs only, not their arrays; they bound the groups
    todo = [r["path"] for r in new.select("path").orderBy("path").collect()]
    if todo:
        times = fields.select("t").distinct().select("t", (F.row_number().over(W.orderBy("t")) - 1).alias("place"))  # one row a month
        placed = sinks.written(fields.join(times, "t").select(F.col("place").cast("long").alias("t"), "vec"), "fields")
        n = placed.count()
    for at in range(0, len(todo), group):
        paths = todo[at : at + group]
        own = listed.filter(F.col("path").isin(paths))
        _append(spark, placed, n, own, paths, ledger, phase)
    return read(spark, ledger).join(listed.select(*KEYS), KEYS, "left_semi").dropDuplicates(KEYS)


def _append(spark: SparkSession, fields: DataFrame, n: int, own: DataFrame, paths: list[str], ledger: str, phase: str) -> None:
    nodes = F.col("rows") * F.col("columns")
    found = sinks.written(saved.assignments(spark, own, paths), "assignments")
    lengths = found.groupBy("run_id").agg(F.count("*").alias("length"))
    state = own.join(lengths, "run_id", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    why = F.when(nodes.isNull(), "The size of the map is not told.").when(F.col("length") != n, F.concat(F.col("length").cast("string"), F.lit(f" assignments for {n} fields.")))
    state = state.select("run_id", "fingerprint", "of_fields", F.lit(phase).alias("phase"), F.concat_ws("x", "rows", "columns").alias("grid"), "initialization", "training_metric", "seed", nodes.alias("n_nodes"), why.alias("why"))
    fine = state.filter("why is null").drop("why")
    good = runs.indices_of_runs(fields, found.join(fine.select("run_id"), "run_id", "left_semi"), fine)
    given = {"n_nodes_total": F.col("n_nodes"), "note": F.col("why")}
    typed = dict(c.split() for c in INDEX_COLUMNS)
    bad = state.filter("why is not null").select(*COLUMNS[:8], *(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in typed.items()))
    good.select(*COLUMNS).unionByName(bad).repartition(1).write.mode("append").parquet(ledger)
