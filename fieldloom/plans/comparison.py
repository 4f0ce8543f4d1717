"""Queries of many runs: three partitions of the same vectors stand for three trained maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import ledger, runs, som, validity
from fieldloom.plans import catalog
from fieldloom.plans.registry import query
from fieldloom.sources import saved, sinks

#: run_id, side of the map, training metric, nodes of a vector.
_RUNS = (("label_4x4", 4, "ssim", "label"), ("mod5_3x3", 3, "ssim", "vec_id % 5"), ("one_3x3", 3, "euclidean", "0"), ("sum_6x6", 6, "euclidean", "(label + vec_id) % 20"))
_ASSIGNED = "run(run_id, size, metric) AS (VALUES " + ", ".join(f"('{r}', {n}, '{m}')" for r, n, m, _ in _RUNS) + "), a AS (" + " UNION ALL ".join(f"SELECT '{r}' AS run_id, vec_id AS t, CAST({e} AS INTEGER) AS node FROM embeddings" for r, _, _, e in _RUNS) + ")"
_PAIRS = """
long AS (SELECT vec_id AS t, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
half AS (SELECT x.t AS i, y.t AS j, sum((x.v - y.v) * (x.v - y.v)) AS e2, 1 - covar_pop(x.v, y.v) / sqrt(var_pop(x.v) * var_pop(y.v)) AS c,
         ((2 * avg(x.v) * avg(y.v) + 1e-4) * (2 * covar_pop(x.v, y.v) + 9e-4)) / ((avg(x.v) * avg(x.v) + avg(y.v) * avg(y.v) + 1e-4) * (var_pop(x.v) + var_pop(y.v) + 9e-4)) AS ssim
         FROM long x JOIN long y ON x.pos = y.pos AND x.t < y.t GROUP BY ALL)"""
_INDICES = """
d AS (SELECT i, j, e2, c FROM half UNION ALL SELECT j, i, e2, c FROM half),
s AS (SELECT run_id, node, count(*) AS n FROM a GROUP BY ALL),
m AS (SELECT x.run_id, d.i AS t, x.node, y.node AS other, sum(sqrt(e2)) AS e, sum(c) AS c, count(*) AS k FROM d JOIN a x ON x.t = d.i JOIN a y ON y.t = d.j AND y.run_id = x.run_id GROUP BY ALL),
f AS (SELECT run_id, t, max(CASE WHEN node = other THEN e / k END) AS ae, min(CASE WHEN node <> other THEN e / k END) AS be,
             max(CASE WHEN node = other THEN c / k END) AS ac, min(CASE WHEN node <> other THEN c / k END) AS bc FROM m GROUP BY ALL),
sil AS (SELECT run_id, avg(CASE WHEN ae IS NULL THEN 0 ELSE (be - ae) / greatest(ae, be) END) AS se, avg(CASE WHEN ac IS NULL THEN 0 ELSE (bc - ac) / greatest(ac, bc) END) AS sc FROM f GROUP BY run_id),
cen AS (SELECT run_id, node, pos, avg(v) AS c, count(*) AS n, var_pop(v) * count(*) AS w FROM a JOIN long ON long.t = a.t GROUP BY ALL),
mid AS (SELECT pos, avg(v) AS m FROM long GROUP BY pos),
sc AS (SELECT run_id, sum(n * (c - m) * (c - m)) AS b, sum(w) AS w FROM cen JOIN mid ON mid.pos = cen.pos GROUP BY run_id),
gap AS (SELECT a.run_id, a.node, a.t, sqrt(sum((v - c) * (v - c))) AS g FROM a JOIN long ON long.t = a.t JOIN cen ON cen.run_id = a.run_id AND cen.node = a.node AND cen.pos = long.pos GROUP BY ALL),
sp AS (SELECT run_id, node, avg(g) AS s FROM gap GROUP BY ALL),
cc AS (SELECT x.run_id, x.node AS i, y.node AS j, sqrt(sum((x.c - y.c) * (x.c - y.c))) AS d FROM cen x JOIN cen y ON x.run_id = y.run_id AND x.pos = y.pos AND x.node <> y.node GROUP BY ALL),
db AS (SELECT run_id, avg(r) AS db FROM (SELECT cc.run_id, i, max((p.s + q.s) / d) AS r FROM cc JOIN sp p ON p.run_id = cc.run_id AND p.node = i JOIN sp q ON q.run_id = cc.run_id AND q.node = j GROUP BY ALL) GROUP BY run_id),
oc AS (SELECT run_id, CAST(count(*) AS INTEGER) AS k, max(n) * 1.0 / sum(n) AS top, sum(n) AS n, -sum(n / total * ln(n / total)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY run_id) AS total FROM s) GROUP BY run_id),
r AS (SELECT run.run_id, run.metric, CAST(size AS INTEGER) AS size, CAST(size * size AS INTEGER) AS n_nodes_total, CAST(size * size - k AS INTEGER) AS n_nodes_empty, top AS max_node_share, h / ln(size * size) AS occupancy_entropy, k AS n_clusters_occupied,
         CASE WHEN k > 1 THEN se END AS silhouette_euclidean, CASE WHEN k > 1 THEN sil.sc END AS silhouette_correlation, CASE WHEN k > 1 THEN db END AS davies_bouldin,
         CASE WHEN k > 1 THEN b * (n - k) / (w * (k - 1)) END AS calinski_harabasz, CASE WHEN k < 2 THEN 'Fewer than two occupied nodes; indices undefined.' ELSE '' END AS note
      FROM run JOIN oc ON oc.run_id = run.run_id JOIN sil ON sil.run_id = run.run_id JOIN sc ON sc.run_id = run.run_id LEFT JOIN db ON db.run_id = run.run_id)"""
_VALUES = ("max_node_share", "occupancy_entropy", *runs.INDICES)


def _with(*parts: str) -> str:
    return "WITH " + ", ".join((_ASSIGNED, *parts))


def _rounded(columns: tuple[str, ...]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in _VALUES else c for c in columns)


_RECORD = ("run_id", "n_nodes_total", "n_nodes_empty", "max_node_share", "occupancy_entropy", "n_clusters_occupied", *runs.INDICES, "note")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    x = catalog.table(spark, sf_dir, "embeddings")
    rows = F.array(*(F.struct(F.lit(r).alias("run_id"), F.lit(n).alias("size"), F.lit(m).alias("metric")) for r, n, m, _ in _RUNS))
    own = spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
    nodes = F.explode(F.array(*(F.struct(F.lit(r).alias("run_id"), F.expr(e).cast("int").alias("node")) for r, _, _, e in _RUNS))).alias("a")
    return catalog.fields(spark, sf_dir).select("t", "vec"), x.select(F.col("vec_id").alias("t"), nodes).select("a.run_id", "t", "a.node"), own


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields, assignments, own = _inputs(spark, sf_dir)
    return runs.indices_of_runs(fields, runs.checked_lengths(assignments, fields), own)


@query(_with(_PAIRS, _INDICES) + f" SELECT {_rounded(_RECORD)} FROM r")
def run_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All indices of every run, in one job."""
    x = _records(spark, sf_dir)
    return x.select(*(F.round(c, 6).alias(c) if c in _VALUES else c for c in _RECORD))


@query(_with(_PAIRS, _INDICES) + f" SELECT run_id, metric AS training_metric, {_rounded(_RECORD[1:])} FROM r")
def recorded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs saved in folders and evaluated under a ledger: the second call finds one run of the first and computes the other three."""
    fields, assignments, own = _inputs(spark, sf_dir)
    path = sinks.scratch(spark, "saved")
    size = F.col("size").cast("int")
    x = assignments.join(own, "run_id").withColumn("run_id", F.concat("run_id", F.lit("/BMUs")))
    x = x.select("run_id", "t", F.floor(F.col("node") / size).cast("int").alias("node_i"), (F.col("node") % size).alias("node_j"))
    first = F.col("run_id") == f"{_RUNS[0][0]}/BMUs"
    for part, described in ((x.filter(first), _RUNS[:1]), (x.filter(~first), _RUNS[1:])):
        sinks.write_npy(part, f"{path}/runs")
        for run, n, metric, _ in described:
            sinks.write_config({"grid_size": [n, n], "bmu_metric": metric}, f"{path}/runs/{run}")
        found = ledger.evaluate(fields, saved.in_folders(spark, f"{path}/runs"), f"{path}/ledger", "final")
    found = found.withColumn("run_id", F.substring_index("run_id", "/", -1))
    return found.select("training_metric", *(F.round(c, 6).alias(c) if c in _VALUES else c for c in _RECORD))


@query()
def trained_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: a map of each of the 18 configurations is trained, saved under a name that tells map and seed, found, and evaluated."""
    fields = catalog.fields(spark, sf_dir).select("t", "vec")
    root = sinks.scratch(spark, "trained")
    own = som.runs(spark, seeds=(1,))
    folder = F.concat_ws("_", "search", "start")
    name = F.concat(folder, F.lit("/bmu_"), F.concat_ws("x", "size", "size"), F.lit("_oct_mar_seed"), F.col("seed").cast("string"))
    x = som.train_runs(own, fields).select(name.alias("run_id"), "t", F.floor(F.col("node") / F.col("size")).cast("int").alias("node_i"), (F.col("node") % F.col("size")).alias("node_j"))
    sinks.write_npy(x, f"{root}/runs")
    told = {f"{search}_{start}": (search, start) for search in som.SEARCHES for start in som.STARTS}
    found = ledger.evaluate(fields, saved.by_name(spark, f"{root}/runs", told), f"{root}/ledger", "exploratory")
    return found.select("training_metric", "initialization", "grid", "seed", "phase", *_RECORD[1:])


@query(_with(_PAIRS, _INDICES) + f" SELECT {_rounded(_RECORD[1:])} FROM r WHERE run_id = 'label_4x4'")
def validity_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All indices of one partition."""
    x = validity.indices(catalog.fields(spark, sf_dir), 16)
    return x.select(*(F.round(c, 6).alias(c) if c in _VALUES else c for c in _RECORD[1:]))


_MEANS = (("silhouette_euclidean", "sil_euclidean"), ("silhouette_correlation", "sil_correlation"), ("n_clusters_occupied", "nodes_occupied"), ("n_nodes_empty", "nodes_empty"), ("max_node_share", "max_share"), ("occupancy_entropy", "evenness"))


@query(_with(_PAIRS, _INDICES) + " SELECT metric AS training_metric, concat(size, 'x', size) AS grid, count(*) AS n_runs, " + ", ".join(f"round_even(avg({c}), 4) AS {a}" for c, a in _MEANS) + " FROM r GROUP BY ALL")
def validity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and mean indices by training metric and size of map."""
    size = F.col("size").cast("string")
    x = _records(spark, sf_dir).withColumn("training_metric", F.col("metric")).withColumn("grid", F.concat(size, F.lit("x"), size))
    return validity.summary(x)


_SSIM = "p AS (SELECT x.run_id, x.node, avg(ssim) AS s FROM half JOIN a x ON x.t = half.i JOIN a y ON y.t = half.j AND y.run_id = x.run_id AND y.node = x.node GROUP BY ALL), pr AS (SELECT run_id, count(*) AS n_nodes, avg(s) AS mean_ssim FROM p GROUP BY run_id)"


@query(_with(_PAIRS, _SSIM) + " SELECT run_id, n_nodes, round(mean_ssim, 6) AS mean_ssim FROM pr")
def pairwise_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields, assignments, _ = _inputs(spark, sf_dir)
    return runs.coherence_of_runs(fields, assignments).select("run_id", "n_nodes", F.round("mean_ssim", 6).alias("mean_ssim"))


@query(_with(_PAIRS, _SSIM) + " SELECT CAST(size AS INTEGER) AS size, count(*) AS n_runs, round_even(avg(mean_ssim), 4) AS mean_ssim, round_even(stddev_samp(mean_ssim), 4) AS std_ssim FROM pr JOIN run ON run.run_id = pr.run_id GROUP BY size")
def pairwise_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields, assignments, own = _inputs(spark, sf_dir)
    return runs.coherence_by_size(runs.coherence_of_runs(fields, assignments), own)
