"""The driver's tables as the engine's inputs: a gridded cube from orders, fields and a partition from embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The cube: 25 nations as a 5 x 5 grid, months since January 1995, the logarithm of the orders' total of each.
GRID_ROWS, GRID_COLUMNS, FIRST_YEAR = 5, 5, 1995
#: Labels as nodes of a 4 x 4 map, six of which stay empty.
MAP_ROWS, MAP_COLUMNS = 4, 4
PHASES = ((1994, 1.1, "El Niño"), (1995, -1.0, "La Niña"), (1996, -0.5, "La Niña"), (1997, 2.2, "El Niño"), (1998, -1.5, "La Niña"), (1999, -1.7, "La Niña"), (2000, -0.7, "La Niña"))
CUBE_SQL = """
cube AS (
  SELECT CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INTEGER) AS t, CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(month(o_orderdate) AS INTEGER) AS month, c_nationkey AS pixel_id, ln(round(sum(o_totalprice), 2)) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
axis AS (SELECT t, year, month, row_number() OVER (ORDER BY t) - 1 AS pos FROM (SELECT DISTINCT t, year, month FROM cube)),
grid AS (SELECT n_nationkey AS pixel_id, n_nationkey // 5 AS iy, n_nationkey % 5 AS ix FROM nation)"""
FIELDS_SQL = """
fields AS (SELECT vec_id AS t, label AS node, label // 4 AS node_i, label % 4 AS node_j, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
long AS (SELECT t, node, node_i, node_j, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS pos FROM fields)"""
BMU_SQL = """
bmu AS (SELECT axis.t, year, month, label // 4 AS node_i, label % 4 AS node_j, label AS node FROM axis JOIN embeddings ON vec_id = axis.t)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("pixel_id"))
    x = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("year", "month", "pixel_id").agg(F.ln(F.round(F.sum("o_totalprice"), 2)).alias("value"))
    return x.withColumn("t", ((F.col("year") - FIRST_YEAR) * 12 + F.col("month") - 1).cast("int"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    iy, ix = F.floor(k / GRID_COLUMNS).cast("int"), (k % GRID_COLUMNS).cast("int")
    return table(spark, sf_dir, "nation").select(k.alias("pixel_id"), iy.alias("iy"), ix.alias("ix"), iy.cast("double").alias("lat"), ix.cast("double").alias("lon"))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("label")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), n.alias("node"), F.floor(n / MAP_COLUMNS).cast("int").alias("node_i"), (n % MAP_COLUMNS).cast("int").alias("node_j"), F.col("embedding").cast("array<double>").alias("vec"))


def bmu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments by month: the label of the field with the month's number, joined on t."""
    axis = cube(spark, sf_dir).select("t", "year", "month").distinct()
    return axis.join(fields(spark, sf_dir).select(F.col("t").cast("int").alias("t"), "node", "node_i", "node_j"), "t")


def phases(spark: SparkSession) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(y).alias("season_year"), F.lit(o).alias("oni"), F.lit(p).alias("phase")) for y, o, p in PHASES))
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
