"""Assignments to map nodes: labels, categories, counts, shares and seasonal summaries.

bmu(t, year, month, node_i, node_j); (-1, -1) is unassigned and left out of every count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions.calendar import WARM_MONTHS, month_position, season_year
from fieldloom.sources import files

# The node categories of the published 4 x 4 map, and the orders of categories.
DRY = ((0, 0), (0, 1), (1, 0))
WET = ((2, 2), (2, 3), (3, 1), (3, 2), (3, 3))
CATEGORIES = ("Dry", "Transitional", "Wet")
DEFAULT_PHASE = "Neutral"
# Counts of the published map, for where no table of assignments is at hand.
FALLBACK_COUNTS = ((44, 18, 15, 10), (30, 21, 14, 12), (15, 18, 12, 7), (19, 12, 10, 7))


def _among(i: Column, j: Column, pairs: tuple[tuple[int, int], ...]) -> Column:
    hit = F.lit(False)
    for a, b in pairs:
        hit = hit | ((i == a) & (j == b))
    return hit


def category(i: Column, j: Column, dry: tuple = DRY, wet: tuple = WET) -> Column:
    return F.when(_among(i, j, dry), "Dry").when(_among(i, j, wet), "Wet").otherwise("Transitional")


def code(i: Column, j: Column, dry: tuple = DRY, wet: tuple = WET) -> Column:
    """-1 dry, +1 wet, 0 transitional."""
    return F.when(_among(i, j, dry), -1).when(_among(i, j, wet), 1).otherwise(0).cast("int")


def assigned(bmu: DataFrame) -> DataFrame:
    return bmu.filter("node_i >= 0 and node_j >= 0")


def node_grid(df: DataFrame, rows: int, columns: int) -> DataFrame:
    """All nodes of the map."""
    at = F.explode(F.sequence(F.lit(0), F.lit(rows * columns - 1)))
    return df.sparkSession.range(1).select(at.alias("node")).select("node", F.floor(F.col("node") / columns).cast("int").alias("node_i"), (F.col("node") % columns).cast("int").alias("node_j"))


def dense_counts(bmu: DataFrame, rows: int, columns: int) -> DataFrame:
    """Every node's count and its share of all in percent."""
    counts = assigned(bmu).groupBy("node_i", "node_j").agg(F.count("*").alias("n"))
    every = node_grid(bmu, rows, columns).join(counts, ["node_i", "node_j"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return every.withColumn("share", F.try_divide(F.col("n") * 100.0, F.sum("n").over(total)))


def counts_or_published(spark: SparkSession, path: str) -> DataFrame:
    """Counts of the assignments by date at `path`; if there is no such table, those of the published map."""
    if files.present_folders(spark, [path]):
        return dense_counts(files.read_bmu_dates(spark, path), len(FALLBACK_COUNTS), len(FALLBACK_COUNTS[0])).select("node_i", "node_j", "n")
    rows = F.array(*(F.struct(F.lit(i).alias("node_i"), F.lit(j).alias("node_j"), F.lit(n).cast("long").alias("n")) for i, row in enumerate(FALLBACK_COUNTS) for j, n in enumerate(row)))
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def month_node_counts(bmu: DataFrame, columns: int) -> DataFrame:
    x = assigned(bmu).groupBy("month", "node_i", "node_j").agg(F.count("*").alias("n"))
    return x.withColumn("node", F.col("node_i") * columns + F.col("node_j")).withColumn("position", month_position(F.col("month")))


def node_month_dense(bmu: DataFrame, rows: int, columns: int, months: tuple[int, ...] = WARM_MONTHS) -> DataFrame:
    """node x month counts, with zeros, months in the season's order."""
    axis = F.explode(F.array(*map(F.lit, months))).alias("month")
    every = node_grid(bmu, rows, columns).select("node", "node_i", "node_j", axis)
    counts = assigned(bmu).groupBy("node_i", "node_j", "month").agg(F.count("*").alias("n"))
    return every.join(counts, ["node_i", "node_j", "month"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("position", month_position(F.col("month"), months))


def composition(bmu: DataFrame, key: str) -> DataFrame:
    """Counts of categories as columns, with zeros, for each value of a key."""
    x = assigned(bmu).withColumn("category", category(F.col("node_i"), F.col("node_j")))
    return x.groupBy(key).pivot("category", list(CATEGORIES)).agg(F.count(F.lit(1))).na.fill(0)


def shares(counts: DataFrame, key: str) -> DataFrame:
    """Percent of each row; an empty row gets nulls."""
    total = sum((F.col(c) for c in CATEGORIES), F.lit(0))
    return counts.select(key, *(F.try_divide(F.col(c) * 100.0, total).alias(c) for c in CATEGORIES))


def stacked(share: DataFrame, key: str) -> DataFrame:
    """Long form with the offset at which each category's bar starts."""
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")).cast("int")
    long = share.select(key, F.expr(f"stack({len(CATEGORIES)}, {', '.join(f'''{c!r}, `{c}`''' for c in CATEGORIES)}) as (category, share)")).withColumn("rank", rank)
    below = W.partitionBy(key).orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    return long.withColumn("offset", F.coalesce(F.sum("share").over(below), F.lit(0.0)))


def with_season(bmu: DataFrame) -> DataFrame:
    return bmu.withColumn("season_year", season_year(F.col("year"), F.col("month")))


def seasonal_index(bmu: DataFrame, phases: DataFrame | None = None) -> DataFrame:
    """Mean code of each season's months; with a table of phases only seasons that it has."""
    x = with_season(assigned(bmu)).groupBy("season_year").agg(F.avg(code(F.col("node_i"), F.col("node_j"))).alias("mean_index"))
    return x if phases is None else x.join(phases, "season_year")


def season_phase(seasons: DataFrame, phases: DataFrame, default: str = DEFAULT_PHASE) -> DataFrame:
    """Every season with its phase, or the default where the table has none."""
    return seasons.join(phases.select("season_year", "phase"), "season_year", "left").withColumn("phase", F.coalesce("phase", F.lit(default)))


def label_codes(bmu: DataFrame) -> DataFrame:
    """Dense codes 0, 1, ... of the occupied nodes, in their order. The map is small, so is this window."""
    occupied = assigned(bmu).select("node_i", "node_j").distinct()
    return occupied.withColumn("code", F.dense_rank().over(W.orderBy("node_i", "node_j")) - 1)
