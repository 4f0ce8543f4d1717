"""Validity of many runs over the same fields, in one job: fields are compared once, whatever the number of runs.

fields: t, vec. assignments: run_id, t, node (-1 is unassigned and left out). runs: run_id, size (nodes along a side of the map, or
n_nodes, their number) and any columns that describe a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.blocks import pairwise_ssim_by_run, scores_by_run
from fieldloom.operators.validity import NOTE
from fieldloom.sources import sinks

INDICES = ("silhouette_euclidean", "silhouette_correlation", "davies_bouldin", "calinski_harabasz")
#: Runs whose nodes travel with each field.
MAX_RUNS = 100_000


def labelled(fields: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields with the array of their nodes, one for each run, and the runs' places in it (run_id, run). A run without a word on a
    field leaves it unassigned."""
    names = [r[0] for r in assignments.select("run_id").distinct().orderBy("run_id").limit(MAX_RUNS + 1).collect()]
    if len(names) > MAX_RUNS:
        raise ValueError(f"more than {MAX_RUNS} runs; evaluate them in groups")
    spark = fields.sparkSession
    rows = F.array(*(F.struct(F.lit(n).alias("run_id"), F.lit(k).alias("run")) for k, n in enumerate(names))) if names else F.array().cast("array<struct<run_id:string,run:int>>")
    places = spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
    own = assignments.join(places, "run_id").groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("run", "node"))).alias("nodes"))
    node = F.transform(F.sequence(F.lit(0), F.lit(max(0, len(names) - 1))), lambda k: F.coalesce(F.try_element_at("nodes", k), F.lit(-1)).cast("int"))
    return fields.join(own, "t").select("t", node.alias("node"), "vec"), places


def indices_of_runs(fields: DataFrame, assignments: DataFrame, runs: DataFrame, degenerate: str = "null") -> DataFrame:
    """One row for each run: occupancy, both silhouettes, Davies-Bouldin and Calinski-Harabasz, with the run's own columns and a note.

    All come from sums of distances between fields and nodes: scatter within a node is the sum of its squared distances over twice
    its size, and distances to and between centroids follow from that. Below two occupied nodes indices are null
    (degenerate="null") or 0, infinity and 0 (degenerate="scores"); with as many nodes as fields they are null.
    """
    vectors, places = labelled(fields, assignments)
    rows = sinks.written(scores_by_run(vectors), "scores")  # several aggregates below read them; the fields are compared once
    own = vectors.select("t", F.posexplode("node").alias("run", "node")).filter("node >= 0")
    sizes = own.groupBy("run", "node").agg(F.count("*").alias("n"))
    by_field = rows.filter("other is null").select("run", "node", "se", "sc", "to_own", F.col("s").alias("e2"))
    silhouettes = by_field.groupBy("run").agg(F.avg("se").alias("se"), F.avg("sc").alias("sc"), F.count("*").alias("total"), (F.sum("e2") / (2 * F.count("*"))).alias("scatter"))
    pairs = rows.filter("other is not null").groupBy("run", "node", "other").agg(F.sum("s").alias("e2"), F.sum("n").alias("n"))
    within = pairs.filter("node = other").select("run", "node", "n", (F.col("e2") / (2 * F.col("n"))).alias("w"))
    root = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))
    spread = by_field.join(within, ["run", "node"]).groupBy("run", "node").agg(F.avg(root(F.col("to_own") - F.col("w") / F.col("n"))).alias("s"), F.max("w").alias("w"), F.max("n").alias("n"))
    far = spread.select("run", F.col("node").alias("other"), F.col("s").alias("s2"), F.col("w").alias("w2"), F.col("n").alias("n2"))
    gaps = pairs.filter("node <> other").select("run", "node", "other", "e2").join(spread, ["run", "node"]).join(far, ["run", "other"])
    gap = root(F.col("e2") / (F.col("n") * F.col("n2")) - F.col("w") / F.col("n") - F.col("w2") / F.col("n2"))
    worst = gaps.groupBy("run", "node").agg(F.max(F.coalesce(F.try_divide(F.col("s") + F.col("s2"), gap), F.lit(0.0))).alias("r"))
    bouldin = worst.groupBy("run").agg(F.avg("r").alias("db"))
    by_run = within.groupBy("run").agg(F.sum("w").alias("w"), F.count("*").cast("int").alias("k"))
    shares = sizes.join(silhouettes.select("run", "total"), "run").withColumn("p", F.col("n") / F.col("total"))
    occupied = shares.groupBy("run").agg(F.max("p").alias("max_node_share"), F.sum(-F.col("p") * F.ln("p")).alias("entropy"))
    every = runs.join(places, "run_id").join(silhouettes, "run", "left").join(by_run, "run", "left").join(bouldin, "run", "left").join(occupied, "run", "left")
    nodes = F.col("n_nodes") if "n_nodes" in runs.columns else F.col("size") * F.col("size")
    k = F.coalesce("k", F.lit(0))
    fine = (k > 1) & (k < F.col("total"))
    hara = F.when(F.col("w") == 0, F.lit(1.0)).otherwise((F.col("scatter") - F.col("w")) * (F.col("total") - k) / F.nullif(F.col("w") * (k - 1), F.lit(0.0)))
    values = dict(zip(INDICES, (F.col("se"), F.col("sc"), F.col("db"), hara), strict=True))
    bad = dict(zip(INDICES, (0.0, 0.0, float("inf"), 0.0), strict=True))
    few = lambda name: F.when(k < 2, F.lit(bad[name])) if degenerate == "scores" else F.lit(None).cast("double")
    return every.select(
        *(c for c in runs.columns if c != "n_nodes"), nodes.cast("int").alias("n_nodes_total"), (nodes - k).cast("int").alias("n_nodes_empty"), "max_node_share",
        (F.col("entropy") / F.nullif(F.ln(nodes), F.lit(0.0))).alias("occupancy_entropy"), k.cast("int").alias("n_clusters_occupied"),
        *(F.when(fine, v).otherwise(few(name)).alias(name) for name, v in values.items()), F.when(k < 2, NOTE).otherwise("").alias("note"),
    )


def records(fields: DataFrame, assignments: DataFrame, expected: DataFrame, phase: str) -> tuple[DataFrame, DataFrame]:
    """Indices of the runs that are there, with their phase, and the expected runs that are not."""
    found = assignments.select("run_id").distinct()
    present = expected.join(found, "run_id", "left_semi")
    return indices_of_runs(fields, assignments, present).withColumn("phase", F.lit(phase)), expected.join(found, "run_id", "left_anti")


def checked_lengths(assignments: DataFrame, fields: DataFrame, strict: bool = True) -> DataFrame:
    """Assignments of the runs that have one for each field. A run of another length is an error, or is skipped if not strict."""
    n = fields.count()
    lengths = assignments.groupBy("run_id").agg(F.count("*").alias("length"))
    if strict:
        said = F.concat(F.lit("run "), F.col("run_id").cast("string"), F.lit(" has "), F.col("length").cast("string"), F.lit(f" assignments for {n} fields"))
        lengths = lengths.filter(F.when(F.col("length") == n, True).otherwise(F.raise_error(said)))
    else:
        lengths = lengths.filter(F.col("length") == n)
    return assignments.join(lengths.select("run_id"), "run_id", "left_semi")


def common_length(assignments: DataFrame, times: DataFrame) -> DataFrame:
    """Assignments (t from 0) with the dates of the same number, as far as both go."""
    return assignments.join(times, "t")


def coherence_of_runs(fields: DataFrame, assignments: DataFrame) -> DataFrame:
    """run_id, n_nodes, mean_ssim: the mean over nodes of the mean similarity of their pairs; nodes without a pair do not count."""
    vectors, places = labelled(fields, assignments)
    by_node = pairwise_ssim_by_run(vectors).select("run", F.try_divide("ssim_sum", F.nullif("n_pairs", F.lit(0))).alias("s"))
    return by_node.groupBy("run").agg(F.count("s").alias("n_nodes"), F.avg("s").alias("mean_ssim")).join(places, "run").select("run_id", "n_nodes", "mean_ssim")


def coherence_by_size(per_run: DataFrame, runs: DataFrame) -> DataFrame:
    """Mean and sample deviation of the runs of each size of map, to four digits, half to even."""
    x = per_run.join(runs.select("run_id", "size"), "run_id").groupBy("size")
    return x.agg(F.count("*").alias("n_runs"), F.bround(F.avg("mean_ssim"), 4).alias("mean_ssim"), F.bround(F.stddev_samp("mean_ssim"), 4).alias("std_ssim"))
