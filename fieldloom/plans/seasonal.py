"""Queries of months, seasons and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.calendar import flat_label, in_season, month_position, season_year
from fieldloom.operators import nodes, stats
from fieldloom.plans import catalog
from fieldloom.plans.catalog import BMU_SQL, CUBE_SQL
from fieldloom.plans.registry import query

_PHASES = "phases AS (SELECT * FROM (VALUES " + ", ".join(f"({y}, CAST({o} AS DOUBLE), '{p}')" for y, o, p in catalog.PHASES) + ") AS p(season_year, oni, phase))"
_DRY = "(node_i, node_j) IN ((0, 0), (0, 1), (1, 0))"
_WET = "(node_i, node_j) IN ((2, 2), (2, 3), (3, 1), (3, 2), (3, 3))"
_CODE = f"CASE WHEN {_DRY} THEN -1 WHEN {_WET} THEN 1 ELSE 0 END"
_CATEGORY = f"CASE WHEN {_DRY} THEN 'Dry' WHEN {_WET} THEN 'Wet' ELSE 'Transitional' END"
_SEASON = "CASE WHEN month >= 10 THEN year ELSE year - 1 END"
_POSITION = "CAST(list_position([10, 11, 12, 1, 2, 3], month) - 1 AS INTEGER)"
_NODES = "nodes AS (SELECT CAST(n AS INTEGER) AS node, CAST(n // 4 AS INTEGER) AS node_i, CAST(n % 4 AS INTEGER) AS node_j FROM range(16) AS r(n))"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


@query("SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders WHERE month(o_orderdate) IN (10, 11, 12, 1, 2, 3)")
def month_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.month("o_orderdate")
    return catalog.table(spark, sf_dir, "orders").filter(in_season(month)).select("o_orderkey", month.alias("month"))


@query("SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) >= 10 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS INTEGER) AS season_year FROM orders")
def season_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "orders").select("o_orderkey", season_year(F.year("o_orderdate"), F.month("o_orderdate")).alias("season_year"))


@query("SELECT vec_id AS t, CAST((label // 4) * 4 + label % 4 AS INTEGER) AS node FROM embeddings")
def flat_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.fields(spark, sf_dir).select("t", flat_label(F.col("node_i"), F.col("node_j"), catalog.MAP_COLUMNS).alias("node"))


@query(f"SELECT t, CAST({_CODE} AS INTEGER) AS code FROM (SELECT vec_id AS t, label // 4 AS node_i, label % 4 AS node_j FROM embeddings)")
def node_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.fields(spark, sf_dir).select("t", nodes.code(F.col("node_i"), F.col("node_j")).alias("code"))


@query(f"SELECT t, {_CATEGORY} AS category FROM (SELECT vec_id AS t, label // 4 AS node_i, label % 4 AS node_j FROM embeddings)")
def node_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.fields(spark, sf_dir).select("t", nodes.category(F.col("node_i"), F.col("node_j")).alias("category"))


@query(_with(CUBE_SQL) + f" SELECT t, month, {_POSITION} AS position FROM axis WHERE month IN (10, 11, 12, 1, 2, 3)")
def month_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = catalog.cube(spark, sf_dir).select("t", "month").distinct().filter(in_season(F.col("month")))
    return axis.select("t", "month", month_position(F.col("month")).alias("position"))


@query(_with(CUBE_SQL, BMU_SQL) + " SELECT t, year, month, node_i, node_j, node FROM bmu")
def bmu_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.bmu(spark, sf_dir).select("t", "year", "month", "node_i", "node_j", "node")


@query(_with(CUBE_SQL, BMU_SQL) + f" SELECT CAST({_SEASON} AS INTEGER) AS season_year, round(avg({_CODE}), 8) AS mean_index FROM bmu WHERE month IN (10, 11, 12, 1, 2, 3) GROUP BY ALL")
def season_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = catalog.bmu(spark, sf_dir).filter(in_season(F.col("month")))
    return nodes.seasonal_index(b).select("season_year", F.round("mean_index", 8).alias("mean_index"))


@query(_with(CUBE_SQL, BMU_SQL, _PHASES) + f" SELECT s.season_year, mean_index, oni, phase FROM (SELECT CAST({_SEASON} AS INTEGER) AS season_year, round(avg({_CODE}), 8) AS mean_index FROM bmu WHERE month IN (10, 11, 12, 1, 2, 3) GROUP BY ALL) s JOIN phases ON s.season_year = phases.season_year")
def season_index_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = catalog.bmu(spark, sf_dir).filter(in_season(F.col("month")))
    return nodes.seasonal_index(b, catalog.phases(spark)).select("season_year", F.round("mean_index", 8).alias("mean_index"), "oni", "phase")


@query(_with(CUBE_SQL, BMU_SQL, _PHASES) + f" SELECT s.season_year, n, coalesce(phase, 'Neutral') AS phase FROM (SELECT CAST({_SEASON} AS INTEGER) AS season_year, count(*) AS n FROM bmu GROUP BY ALL) s LEFT JOIN phases ON s.season_year = phases.season_year")
def season_phase_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    seasons = nodes.with_season(catalog.bmu(spark, sf_dir)).groupBy("season_year").agg(F.count("*").alias("n"))
    return nodes.season_phase(seasons, catalog.phases(spark)).select("season_year", "n", "phase")


def _share_sql(key: str, source: str) -> str:
    count = lambda c: f"count(*) FILTER (WHERE category = '{c}')"
    return f"SELECT {key}, " + ", ".join(f'round({count(c)} * 100.0 / count(*), 6) AS "{c}"' for c in nodes.CATEGORIES) + f" FROM ({source}) GROUP BY {key}"


_CATEGORISED = f"SELECT CAST({_SEASON} AS INTEGER) AS season_year, month, {_CATEGORY} AS category FROM bmu"


def _rounded(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, *(F.round(c, 6).alias(c) for c in nodes.CATEGORIES))


@query(_with(CUBE_SQL, BMU_SQL) + " " + _share_sql("month", _CATEGORISED))
def month_category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(nodes.shares(nodes.composition(catalog.bmu(spark, sf_dir), "month"), "month"), "month")


@query(_with(CUBE_SQL, BMU_SQL) + " " + _share_sql("season_year", _CATEGORISED))
def season_category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(nodes.shares(nodes.composition(nodes.with_season(catalog.bmu(spark, sf_dir)), "season_year"), "season_year"), "season_year")


@query(
    _with(CUBE_SQL, BMU_SQL, f"c AS ({_CATEGORISED})", "k AS (SELECT * FROM (VALUES ('Dry', 1), ('Transitional', 2), ('Wet', 3)) AS v(category, rank))",
          "n AS (SELECT month, category, count(*) AS n FROM c GROUP BY month, category)", "a AS (SELECT month, count(*) AS total FROM c GROUP BY month)",
          "s AS (SELECT a.month, k.category, k.rank, coalesce(n.n, 0) * 100.0 / a.total AS share FROM a CROSS JOIN k LEFT JOIN n ON n.month = a.month AND n.category = k.category)")
    + ' SELECT month, category, CAST(rank AS INTEGER) AS rank, round(share, 6) AS share, round(coalesce(sum(share) OVER (PARTITION BY month ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS "offset" FROM s'
)
def stack_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = nodes.shares(nodes.composition(catalog.bmu(spark, sf_dir), "month"), "month")
    return nodes.stacked(share, "month").select("month", "category", "rank", F.round("share", 6).alias("share"), F.round("offset", 6).alias("offset"))


@query(_with(CUBE_SQL, BMU_SQL) + f" SELECT month, node_i, node_j, CAST(node_i * 4 + node_j AS INTEGER) AS node, count(*) AS n, {_POSITION} AS position FROM bmu WHERE month IN (10, 11, 12, 1, 2, 3) GROUP BY ALL")
def month_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = catalog.bmu(spark, sf_dir).filter(in_season(F.col("month")))
    return nodes.month_node_counts(b, catalog.MAP_COLUMNS).select("month", "node_i", "node_j", "node", "n", "position")


@query(_with(CUBE_SQL, BMU_SQL, _NODES, "m AS (SELECT unnest([10, 11, 12, 1, 2, 3]) AS month)") + f" SELECT nodes.node, nodes.node_i, nodes.node_j, CAST(m.month AS INTEGER) AS month, count(bmu.t) AS n, CAST(list_position([10, 11, 12, 1, 2, 3], m.month) - 1 AS INTEGER) AS position FROM nodes CROSS JOIN m LEFT JOIN bmu ON bmu.node_i = nodes.node_i AND bmu.node_j = nodes.node_j AND bmu.month = m.month GROUP BY ALL")
def node_month_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.node_month_dense(catalog.bmu(spark, sf_dir), catalog.MAP_ROWS, catalog.MAP_COLUMNS).select("node", "node_i", "node_j", "month", "n", "position")


@query(_with(CUBE_SQL, BMU_SQL, _NODES) + " SELECT nodes.node, nodes.node_i, nodes.node_j, count(bmu.t) AS n, round(count(bmu.t) * 100.0 / (SELECT count(*) FROM bmu), 6) AS share FROM nodes LEFT JOIN bmu ON bmu.node_i = nodes.node_i AND bmu.node_j = nodes.node_j GROUP BY ALL")
def node_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.dense_counts(catalog.bmu(spark, sf_dir), catalog.MAP_ROWS, catalog.MAP_COLUMNS).select("node", "node_i", "node_j", "n", F.round("share", 6).alias("share"))


@query(_with(CUBE_SQL, BMU_SQL) + " SELECT DISTINCT node_i, node_j, CAST(dense_rank() OVER (ORDER BY node_i, node_j) - 1 AS INTEGER) AS code FROM bmu")
def distinct_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.label_codes(catalog.bmu(spark, sf_dir)).select("node_i", "node_j", "code")


@query(_with(CUBE_SQL, BMU_SQL) + " SELECT DISTINCT node_i, node_j, year, month FROM bmu")
def months_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.bmu(spark, sf_dir).select("node_i", "node_j", "year", "month").distinct()


@query(_with(CUBE_SQL) + " SELECT min(year * 100 + month) AS first_month, max(year * 100 + month) AS last_month, count(DISTINCT t) AS n_times, count(*) AS n_values, round(min(value), 8) AS low, round(max(value), 8) AS high FROM cube")
def record_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("year") * 100 + F.col("month")
    return catalog.cube(spark, sf_dir).agg(F.min(label).alias("first_month"), F.max(label).alias("last_month"), F.count_distinct("t").alias("n_times"), F.count("*").alias("n_values"), F.round(F.min("value"), 8).alias("low"), F.round(F.max("value"), 8).alias("high"))


_GROUPS = "v AS (SELECT c_mktsegment AS g, c_acctbal AS v FROM customer)"


def _anova_sql(source: str) -> str:
    return f"""
, b AS (SELECT g, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS w FROM {source} GROUP BY g),
a AS (SELECT sum(n) AS total, sum(n * m) / sum(n) AS grand, count(*) AS k, sum(w) AS within FROM b)
SELECT round((sum(n * (m - grand) * (m - grand)) / (any_value(k) - 1)) / (any_value(within) / (any_value(total) - any_value(k))), 8) AS statistic,
       CAST(any_value(k) - 1 AS BIGINT) AS df1, CAST(any_value(total) - any_value(k) AS BIGINT) AS df2 FROM b, a"""


@query(_with(_GROUPS) + _anova_sql("v"))
def anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = stats.anova(catalog.table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")
    return x.select(F.round("statistic", 8).alias("statistic"), F.col("df1").cast("long").alias("df1"), F.col("df2").cast("long").alias("df2"))


@query(_with(_GROUPS, "c AS (SELECT g, median(v) AS c FROM v GROUP BY g)", "d AS (SELECT v.g, abs(v - c) AS v FROM v JOIN c ON v.g = c.g)") + _anova_sql("d"))
def levene(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = stats.levene(catalog.table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")
    return x.select(F.round("statistic", 8).alias("statistic"), F.col("df1").cast("long").alias("df1"), F.col("df2").cast("long").alias("df2"))


@query(
    _with("v AS (SELECT p_brand AS g, CAST(p_size AS DOUBLE) AS v FROM part)",
          "r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY v) AS ties FROM v)",
          "b AS (SELECT g, sum(r) AS r, count(*) AS n, sum(CAST(ties * ties - 1 AS DOUBLE)) AS tie FROM r GROUP BY g)",
          "a AS (SELECT CAST(sum(n) AS DOUBLE) AS n, sum(r * r / n) AS s, sum(tie) AS tie, count(*) AS k FROM b)")
    + " SELECT round((12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - tie / (n * (n * n - 1))), 6) AS statistic, k - 1 AS df FROM a"
)
def kruskal(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = stats.kruskal(catalog.table(spark, sf_dir, "part"), "p_brand", "p_size")
    return x.select(F.round("statistic", 6).alias("statistic"), F.col("df").cast("long").alias("df"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 8) AS r, count(*) AS n FROM lineitem")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pearson(catalog.table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("r", 8).alias("r"), "n")


@query(
    "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry FROM lineitem)"
    " SELECT round(corr(rx, ry), 8) AS r, count(*) AS n FROM r"
)
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman(catalog.table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("r", 8).alias("r"), "n")


@query()
def phase_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = catalog.bmu(spark, sf_dir).filter(in_season(F.col("month")))
    return stats.phase_tests(nodes.seasonal_index(b, catalog.phases(spark)))


_SEASONS = f"s AS (SELECT x.season_year, x.v, oni, phase FROM (SELECT CAST({_SEASON} AS INTEGER) AS season_year, avg({_CODE}) AS v FROM bmu WHERE month IN (10, 11, 12, 1, 2, 3) GROUP BY ALL) x JOIN phases ON phases.season_year = x.season_year)"


@query(
    _with(CUBE_SQL, BMU_SQL, _PHASES, _SEASONS, "r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rv, rank() OVER (ORDER BY oni) + (count(*) OVER (PARTITION BY oni) - 1) / 2.0 AS ro, count(*) OVER (PARTITION BY v) AS ties FROM s)",
          "b AS (SELECT phase, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS w, sum(rv) AS r, sum(CAST(ties * ties - 1 AS DOUBLE)) AS tie FROM r GROUP BY phase)",
          "a AS (SELECT CAST(sum(n) AS DOUBLE) AS n, sum(n * m) / sum(n) AS grand, CAST(count(*) AS DOUBLE) AS k, sum(w) AS w, sum(r * r / n) AS rr, sum(tie) AS tie FROM b)")
    + " SELECT (SELECT CAST(count(*) AS INTEGER) FROM s WHERE phase = 'El Niño') AS n_el_nino, (SELECT CAST(count(*) AS INTEGER) FROM s WHERE phase = 'Neutral') AS n_neutral, (SELECT CAST(count(*) AS INTEGER) FROM s WHERE phase = 'La Niña') AS n_la_nina,"
    ' (SELECT round((sum(b.n * (m - grand) * (m - grand)) / (any_value(k) - 1)) / (any_value(a.w) / (any_value(a.n) - any_value(k))), 6) FROM a, b) AS "anova_F",'
    ' (SELECT round((12.0 / (n * (n + 1)) * rr - 3 * (n + 1)) / (1 - tie / (n * (n * n - 1))), 6) FROM a) AS "kruskal_H",'
    " (SELECT round(corr(oni, v), 6) FROM s) AS pearson_r, (SELECT round(corr(ro, rv), 6) FROM r) AS spearman_rho"
)
def phase_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group sizes and test statistics of the one-row summary; its p-values have no SQL."""
    x = phase_tests(spark, sf_dir)
    return x.select("n_el_nino", "n_neutral", "n_la_nina", *(F.round(c, 6).alias(c) for c in ("anova_F", "kruskal_H", "pearson_r", "spearman_rho")))
