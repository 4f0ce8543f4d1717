"""Queries of similarity, maps and validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import blocks, bmu, nodes, sliding, som, validity
from fieldloom.plans import catalog
from fieldloom.plans.catalog import FIELDS_SQL
from fieldloom.plans.registry import query
from fieldloom.sources import files

_PROTO = "proto AS (SELECT node, pos, avg(v) AS w FROM long GROUP BY node, pos)"
_SUMS = """
pairs AS (SELECT l.t, any_value(l.node) AS own, p.node, count(*) AS n, avg(l.v) AS mx, avg(w) AS mw, var_pop(l.v) AS vx, var_pop(w) AS vw, covar_pop(l.v, w) AS cov,
          sqrt(sum((l.v - w) * (l.v - w))) AS d_euclidean FROM long l JOIN proto p ON l.pos = p.pos GROUP BY l.t, p.node),
scored AS (SELECT *, CASE WHEN vx = 0 OR vw = 0 THEN 1.0 ELSE 1 - cov / sqrt(vx * vw) END AS d_correlation,
           ((2 * mx * mw + 1e-4) * (2 * cov + 9e-4)) / ((mx * mx + mw * mw + 1e-4) * (vx + vw + 9e-4)) AS ssim FROM pairs)"""
_DISTANCES = """
dist AS (SELECT a.t AS i, b.t AS j, any_value(a.node) AS ni, any_value(b.node) AS nj, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d_euclid, 1 - covar_pop(a.v, b.v) / sqrt(var_pop(a.v) * var_pop(b.v)) AS d_corr,
         ((2 * avg(a.v) * avg(b.v) + 1e-4) * (2 * covar_pop(a.v, b.v) + 9e-4)) / ((avg(a.v) * avg(a.v) + avg(b.v) * avg(b.v) + 1e-4) * (var_pop(a.v) + var_pop(b.v) + 9e-4)) AS ssim
         FROM long a JOIN long b ON a.pos = b.pos AND a.t < b.t GROUP BY a.t, b.t)"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join((FIELDS_SQL, *parts))


def _best(order: str) -> str:
    return f"best AS (SELECT t, node, row_number() OVER (PARTITION BY t ORDER BY {order}, node) AS k FROM scored)"


@query(_with(_PROTO, _SUMS, _best("-ssim"), "nodes AS (SELECT CAST(n AS INTEGER) AS node FROM range(16) AS r(n))") + " SELECT nodes.node, count(best.t) AS n FROM nodes LEFT JOIN best ON best.node = nodes.node AND k = 1 GROUP BY nodes.node")
def bmu_ssim_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = catalog.fields(spark, sf_dir)
    found = bmu.assign(x, bmu.prototypes_of(x), "ssim")
    pair = found.select(F.floor(F.col("node") / catalog.MAP_COLUMNS).cast("int").alias("node_i"), (F.col("node") % catalog.MAP_COLUMNS).cast("int").alias("node_j"))
    return nodes.dense_counts(pair, catalog.MAP_ROWS, catalog.MAP_COLUMNS).select("node", "n")


def _assigned(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    x = catalog.fields(spark, sf_dir)
    return bmu.assign(x, bmu.prototypes_of(x), name).select("t", "node")


@query(_with(_PROTO, _SUMS, _best("d_euclidean")) + " SELECT t, node FROM best WHERE k = 1")
def bmu_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir, "euclidean")


@query(_with(_PROTO, _SUMS, _best("d_correlation")) + " SELECT t, node FROM best WHERE k = 1")
def bmu_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir, "correlation")


@query(_with(_PROTO, _SUMS, _best("-ssim")) + " SELECT t, node FROM best WHERE k = 1")
def bmu_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir, "ssim")


@query(_with(_PROTO, _SUMS) + " SELECT t, node, round(d_euclidean, 6) AS d_euclidean, round(d_correlation, 6) AS d_correlation, round(ssim, 6) AS ssim FROM scored")
def field_prototype_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = catalog.fields(spark, sf_dir)
    found = bmu.distances_to(x.drop("node"), bmu.prototypes_of(x), "ssim")
    from fieldloom.functions.metrics import METRICS

    pair = bmu.pair_of()
    return found.select("t", "node", F.round(METRICS["euclidean"](pair), 6).alias("d_euclidean"), F.round(METRICS["correlation"](pair), 6).alias("d_correlation"), F.round(-F.col("d"), 6).alias("ssim"))


@query(_with(_PROTO, _SUMS, "own AS (SELECT t, node, ssim FROM scored WHERE own = node)", "m AS (SELECT node, avg(ssim) AS s FROM own GROUP BY node)") + " SELECT (SELECT round(avg(s), 6) FROM m) AS node_mean, (SELECT round(avg(ssim), 6) FROM own) AS global_mean")
def node_mean_vs_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = catalog.fields(spark, sf_dir)
    return bmu.coherence(bmu.own_prototype(x, bmu.prototypes_of(x))).select(F.round("node_mean", 6).alias("node_mean"), F.round("global_mean", 6).alias("global_mean"))


@query(_with(_PROTO, _SUMS, "nodes AS (SELECT CAST(n AS INTEGER) AS node FROM range(16) AS r(n))") + " SELECT nodes.node, count(s.t) AS n, round(avg(ssim), 6) AS ssim FROM nodes LEFT JOIN (SELECT * FROM scored WHERE own = node) s ON s.node = nodes.node GROUP BY nodes.node")
def ssim_per_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = catalog.fields(spark, sf_dir)
    means = bmu.node_means(bmu.own_prototype(x, bmu.prototypes_of(x)))
    every = nodes.node_grid(x, catalog.MAP_ROWS, catalog.MAP_COLUMNS).join(means, "node", "left")
    return every.select("node", F.coalesce("n", F.lit(0)).alias("n"), F.round("ssim", 6).alias("ssim"))


@query(_with(_DISTANCES) + " SELECT CAST(ni AS INTEGER) AS node, count(*) AS n_pairs, round(avg(ssim), 6) AS ssim FROM dist WHERE ni = nj GROUP BY ni")
def pairwise_within_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = catalog.fields(spark, sf_dir).withColumn("node_key", F.col("node"))
    return blocks.pairwise_ssim(x).select(F.col("node_key").alias("node"), "n_pairs", F.round(F.try_divide("ssim_sum", "n_pairs"), 6).alias("ssim"))


@query(_with(_DISTANCES, "m AS (SELECT ni, avg(ssim) AS s FROM dist WHERE ni = nj GROUP BY ni)") + " SELECT round(avg(s), 6) AS mean_ssim, round(stddev_samp(s), 6) AS std_ssim FROM m")
def pairwise_run_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = catalog.fields(spark, sf_dir).withColumn("node_key", F.col("node"))
    means = blocks.pairwise_ssim(x).select(F.try_divide("ssim_sum", "n_pairs").alias("s"))
    return means.agg(F.round(F.avg("s"), 6).alias("mean_ssim"), F.round(F.stddev_samp("s"), 6).alias("std_ssim"))


@query(_with(_DISTANCES) + " SELECT i, j, round(d_euclid, 6) AS d_euclid FROM dist")
def dist_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.distances(catalog.fields(spark, sf_dir), ("d_euclid",)).select("i", "j", F.round("d_euclid", 6).alias("d_euclid"))


@query(_with(_DISTANCES) + " SELECT i, j, round(d_corr, 6) AS d_corr FROM dist")
def dist_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.distances(catalog.fields(spark, sf_dir), ("d_corr",)).select("i", "j", F.round("d_corr", 6).alias("d_corr"))


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), p AS (SELECT n / sum(n) OVER () AS p FROM c) SELECT CAST(16 AS INTEGER) AS n_nodes_total, CAST(16 - count(*) AS INTEGER) AS n_nodes_empty, round(max(p), 8) AS max_node_share, round(-sum(p * ln(p)) / ln(16), 8) AS occupancy_entropy, CAST(count(*) AS INTEGER) AS n_clusters_occupied FROM p")
def occupancy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = validity.occupancy(catalog.fields(spark, sf_dir), 16)
    return x.select("n_nodes_total", "n_nodes_empty", F.round("max_node_share", 8).alias("max_node_share"), F.round("occupancy_entropy", 8).alias("occupancy_entropy"), "n_clusters_occupied")


def _silhouette_sql(d: str) -> str:
    return _with(_DISTANCES, f"b AS (SELECT i AS t, ni AS own, nj AS other, {d} AS d FROM dist UNION ALL SELECT j, nj, ni, {d} FROM dist)", "m AS (SELECT t, own, other, avg(d) AS d FROM b GROUP BY ALL)",
                 "s AS (SELECT t, max(CASE WHEN own = other THEN d END) AS a, min(CASE WHEN own <> other THEN d END) AS b FROM m GROUP BY t)") + " SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s"


@query(_silhouette_sql("d_euclid"))
def silhouette_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.silhouette_euclidean(catalog.fields(spark, sf_dir)).select(F.round("silhouette", 6).alias("silhouette"))


@query(_silhouette_sql("d_corr"))
def silhouette_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.silhouette_correlation(catalog.fields(spark, sf_dir)).select(F.round("silhouette", 6).alias("silhouette"))


@query(
    _with(_PROTO, "g AS (SELECT l.t, any_value(l.node) AS node, sqrt(sum((v - w) * (v - w))) AS d FROM long l JOIN proto p ON p.node = l.node AND p.pos = l.pos GROUP BY l.t)", "s AS (SELECT node, avg(d) AS s FROM g GROUP BY node)",
          "c AS (SELECT a.node AS i, b.node AS j, sqrt(sum((a.w - b.w) * (a.w - b.w))) AS d FROM proto a JOIN proto b ON a.pos = b.pos AND a.node <> b.node GROUP BY ALL)",
          "r AS (SELECT i, max((x.s + y.s) / d) AS r FROM c JOIN s x ON x.node = i JOIN s y ON y.node = j GROUP BY i)")
    + " SELECT round(avg(r), 6) AS davies_bouldin FROM r"
)
def davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.davies_bouldin(catalog.fields(spark, sf_dir)).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query(
    _with("b AS (SELECT node, pos, count(*) AS n, avg(v) AS c, var_pop(v) * count(*) AS w FROM long GROUP BY node, pos)", "m AS (SELECT pos, avg(v) AS m FROM long GROUP BY pos)",
          "a AS (SELECT sum(n * (c - m) * (c - m)) AS between, sum(w) AS within FROM b JOIN m ON m.pos = b.pos)", "k AS (SELECT count(DISTINCT node) AS k, count(*) AS n FROM fields)")
    + " SELECT round(between * (n - k) / (within * (k - 1)), 6) AS calinski_harabasz FROM a, k"
)
def calinski_harabasz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.calinski_harabasz(catalog.fields(spark, sf_dir)).select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


_KERNEL = "k AS (SELECT CAST(n AS INTEGER) - 2 AS o, exp(-((n - 2) * (n - 2)) / 4.5) AS g FROM range(5) AS r(n)), kn AS (SELECT o, g / (SELECT sum(g) FROM k) AS g FROM k)"
_MIRROR = "CASE WHEN {0} < 0 THEN -1 - ({0}) WHEN {0} > 7 THEN 15 - ({0}) ELSE {0} END"


def _sliding(valid: str) -> str:
    """Window means run over the valid cells of each window."""
    return _with(
        _PROTO, _KERNEL, f"cell AS (SELECT l.t, l.node, l.pos // 8 AS y, l.pos % 8 AS x, l.v AS a, p.w AS b FROM long l JOIN proto p ON p.node = l.node AND p.pos = l.pos WHERE {valid.format('l.pos')})",
        "place AS (SELECT CAST(n // 8 AS INTEGER) AS y, CAST(n % 8 AS INTEGER) AS x FROM range(64) AS r(n))",
        f"tap AS (SELECT y, x, {_MIRROR.format('y + ky.o')} AS yy, {_MIRROR.format('x + kx.o')} AS xx, ky.g * kx.g AS g FROM place, kn ky, kn kx)",
        "conv AS (SELECT t, any_value(node) AS node, tap.y, tap.x, sum(g * a) / sum(g) AS ma, sum(g * b) / sum(g) AS mb, sum(g * a * a) / sum(g) AS aa, sum(g * b * b) / sum(g) AS bb, sum(g * a * b) / sum(g) AS ab FROM tap JOIN cell ON cell.y = yy AND cell.x = xx GROUP BY t, tap.y, tap.x)",
        "slid AS (SELECT t, CAST(any_value(node) AS INTEGER) AS node, avg((2 * ma * mb + 1e-4) * (2 * (ab - ma * mb) + 9e-4) / ((ma * ma + mb * mb + 1e-4) * (aa - ma * ma + bb - mb * mb + 9e-4) + 1e-12)) AS ssim FROM conv GROUP BY t)",
    )


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = catalog.fields(spark, sf_dir)
    return x.join(bmu.prototypes_of(x).withColumnRenamed("vec", "w"), "node")


@query(_sliding("true") + " SELECT t, node, round(ssim, 6) AS ssim FROM slid")
def ssim_sliding_8x8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding.sliding_ssim(_pairs(spark, sf_dir), (8, 8), size=5, sigma=1.5).select("t", "node", F.round("ssim", 6).alias("ssim"))


@query(_sliding("{0} % 7 <> 0") + " SELECT t, node, round(ssim, 6) AS ssim FROM slid")
def ssim_sliding_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a tenth and more of the cells missing; windows have the means of their valid cells."""
    import numpy as np

    mask = (np.arange(64) % 7 != 0).reshape(8, 8)
    kept = lambda c: F.filter(c, lambda v, k: k % 7 != 0)
    pairs = _pairs(spark, sf_dir).select("t", "node", kept("vec").alias("vec"), kept("w").alias("w"))
    return sliding.sliding_ssim(pairs, (8, 8), mask, size=5, sigma=1.5).select("t", "node", F.round("ssim", 6).alias("ssim"))


@query(_sliding("true") + " SELECT (SELECT round(avg(s), 6) FROM (SELECT avg(ssim) AS s FROM slid GROUP BY node)) AS node_mean, (SELECT round(avg(ssim), 6) FROM slid) AS global_mean")
def sliding_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sliding.sliding_coherence(_pairs(spark, sf_dir), (8, 8), size=5, sigma=1.5)
    return x.select(F.round("node_mean", 6).alias("node_mean"), F.round("global_mean", 6).alias("global_mean"))


def _scaled(x: DataFrame) -> DataFrame:
    """Every element of the vectors to [0, 1] over its own range."""
    long = x.select("t", F.posexplode("vec").alias("pos", "v"))
    r = long.groupBy("pos").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    y = long.join(r, "pos").withColumn("v", F.coalesce(F.try_divide(F.col("v") - F.col("low"), F.nullif(F.col("high") - F.col("low"), F.lit(0.0))), F.lit(0.5)))
    return y.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("vec"))


@query()
def multiseed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 216 exploratory runs."""
    return som.train_runs(som.runs(spark), _scaled(catalog.fields(spark, sf_dir))).select("run_id", "t", "node")


@query()
def som_epoch_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    found, _ = som.train_final(_scaled(catalog.fields(spark, sf_dir)), [som.FinalConfig()], np.ones((8, 8), bool))
    return found


@query("WITH e AS (SELECT s AS search, t AS start, g AS size FROM (VALUES ('euclidean'), ('correlation'), ('ssim')) a(s), (VALUES ('pca'), ('random')) b(t), (VALUES (3), (4), (6)) c(g)), p AS (SELECT DISTINCT CASE WHEN label % 3 = 0 THEN 'ssim' ELSE 'euclidean' END AS search, CASE WHEN label % 2 = 0 THEN 'pca' ELSE 'random' END AS start, CAST(CASE WHEN label < 5 THEN 3 ELSE 4 END AS INTEGER) AS size FROM embeddings) SELECT search, start, CAST(size AS INTEGER) AS size FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.search = e.search AND p.start = e.start AND p.size = e.size)")
def missing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("label")
    present = catalog.table(spark, sf_dir, "embeddings").select(F.when(n % 3 == 0, "ssim").otherwise("euclidean").alias("search"), F.when(n % 2 == 0, "pca").otherwise("random").alias("start"), F.when(n < 5, 3).otherwise(4).alias("size"))
    expected = som.runs(spark, seeds=(1,)).select("search", "start", "size")
    return files.missing(expected, present, ["search", "start", "size"])


@query("WITH f AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN concat('bmu_', label, '.npy') ELSE concat('bmu_', label, 'x', label, '_oct_mar_mascara_seed', vec_id, '.npy') END AS name FROM embeddings) SELECT vec_id, name, CASE WHEN regexp_matches(name, '_\\d+x\\d+_') THEN regexp_extract(name, '_(\\d+x\\d+)_', 1) END AS grid, CASE WHEN regexp_matches(name, '_\\d+x\\d+_') THEN CAST(regexp_extract(name, 'seed(\\d+)', 1) AS INTEGER) END AS seed FROM f")
def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = catalog.table(spark, sf_dir, "embeddings")
    n = F.col("label").cast("string")
    name = F.when(F.col("vec_id") % 5 == 0, F.concat(F.lit("bmu_"), n, F.lit(".npy"))).otherwise(F.concat(F.lit("bmu_"), n, F.lit("x"), n, F.lit("_oct_mar_mascara_seed"), F.col("vec_id").cast("string"), F.lit(".npy")))
    return files.name_parts(x.select("vec_id", name.alias("name")), "name")


@query("SELECT vec_id, CAST(3 + label % 2 AS INTEGER) AS rows, CASE WHEN label % 3 > 0 THEN 'ssim' ELSE 'euclidean' END AS search FROM embeddings")
def config_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations as JSON, the map's size under either of its two keys, a default for the metric."""
    x = catalog.table(spark, sf_dir, "embeddings")
    n = F.col("label")
    side = (3 + n % 2).cast("int")
    one = F.to_json(F.struct(F.array(side, side).alias("grid_size"), F.when(n % 3 > 0, "ssim").alias("bmu_metric")))
    two = F.to_json(F.struct(F.array(side, side).alias("grid"), F.when(n % 3 > 0, "ssim").alias("bmu_metric")))
    parsed = F.from_json(F.when(n % 4 == 0, two).otherwise(one), "grid_size array<int>, grid array<int>, bmu_metric string")
    return x.select("vec_id", parsed.alias("c")).select("vec_id", F.get(F.coalesce("c.grid_size", "c.grid"), F.lit(0)).alias("rows"), F.coalesce("c.bmu_metric", F.lit("euclidean")).alias("search"))


@query("SELECT label AS node, count(*) AS n, 'old' AS origin, CAST(NULL AS BIGINT) AS seed FROM embeddings WHERE vec_id % 2 = 0 GROUP BY label UNION ALL SELECT label, count(*), 'new', CAST(7 AS BIGINT) FROM embeddings WHERE vec_id % 2 = 1 GROUP BY label")
def latest_union_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older records without a column and newer ones with it, in one table."""
    x = catalog.table(spark, sf_dir, "embeddings")
    old = x.filter("vec_id % 2 = 0").groupBy(F.col("label").alias("node")).agg(F.count("*").alias("n")).withColumn("origin", F.lit("old"))
    new = x.filter("vec_id % 2 = 1").groupBy(F.col("label").alias("node")).agg(F.count("*").alias("n")).withColumn("origin", F.lit("new")).withColumn("seed", F.lit(7).cast("long"))
    return old.unionByName(new, allowMissingColumns=True)
