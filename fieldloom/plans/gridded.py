"""Queries of the gridded record: masks, trend, climatology, normalisation, interpolation, composites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import cube as c
from fieldloom.plans import catalog
from fieldloom.plans.catalog import BMU_SQL, CUBE_SQL
from fieldloom.plans.registry import query

_WARM = "warm AS (SELECT * FROM cube WHERE month IN (10, 11, 12, 1, 2, 3))"
_MASK = "mask AS (SELECT pixel_id FROM warm GROUP BY pixel_id HAVING count(DISTINCT t) = (SELECT count(DISTINCT t) FROM warm))"
_PLACES = "places AS (SELECT pixel_id, iy, ix, CAST(row_number() OVER (ORDER BY iy, ix) - 1 AS INTEGER) AS pos FROM grid WHERE pixel_id IN (SELECT pixel_id FROM mask))"
_DETRENDED = "detrended AS (SELECT cube.t, cube.year, cube.month, pixel_id, value - (regr_intercept(value, pos) OVER w + regr_slope(value, pos) OVER w * pos) AS value FROM cube JOIN axis ON cube.t = axis.t WINDOW w AS (PARTITION BY pixel_id))"
_CLIM = "clim AS (SELECT month, pixel_id, avg(value) AS clim FROM cube GROUP BY month, pixel_id)"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join((CUBE_SQL, *parts))


def _warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.season_filter(catalog.cube(spark, sf_dir))


@query(_with(_WARM, _MASK) + " SELECT pixel_id FROM mask")
def mask_all_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.mask(_warm(spark, sf_dir), "all_times")


@query(_with() + " SELECT DISTINCT pixel_id FROM cube WHERE t = (SELECT min(t) FROM cube) AND value IS NOT NULL")
def mask_first_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.mask(catalog.cube(spark, sf_dir), "first_step")


@query(_with() + " SELECT grid.pixel_id FROM grid LEFT JOIN (SELECT pixel_id, max(value) AS top FROM cube WHERE value > 15.5 GROUP BY pixel_id) m ON grid.pixel_id = m.pixel_id WHERE top IS NULL")
def ocean_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = catalog.cube(spark, sf_dir).withColumn("value", F.when(F.col("value") > 15.5, F.col("value")))
    return c.ocean(x, catalog.grid(spark, sf_dir))


@query(_with(_WARM, _MASK, _PLACES) + " SELECT t, pos, round(value, 8) AS value FROM warm JOIN places ON warm.pixel_id = places.pixel_id")
def gather_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    warm = _warm(spark, sf_dir)
    vectors = c.gather(warm, c.positions(c.mask(warm), catalog.grid(spark, sf_dir)))
    return vectors.select("t", F.posexplode("vec").alias("pos", "value")).withColumn("value", F.round("value", 8))


@query(_with(_WARM, _MASK, _PLACES) + " SELECT a.t, grid.pixel_id, CAST(grid.iy AS INTEGER) AS iy, CAST(grid.ix AS INTEGER) AS ix, round(value, 8) AS value FROM (SELECT DISTINCT t FROM warm) a CROSS JOIN grid LEFT JOIN places ON places.pixel_id = grid.pixel_id LEFT JOIN warm ON warm.t = a.t AND warm.pixel_id = places.pixel_id")
def scatter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    warm, grid = _warm(spark, sf_dir), catalog.grid(spark, sf_dir)
    places = c.positions(c.mask(warm), grid)
    every = c.scatter(c.gather(warm, places), places, grid)
    # a month without any valid pixel has no vector; it still has its grid
    bare = warm.select("t").distinct().join(every.select("t").distinct(), "t", "left_anti").withColumn("one", F.lit(1)).join(F.broadcast(grid.withColumn("one", F.lit(1))), "one")
    return every.unionByName(bare.select("t", "pixel_id", "iy", "ix", F.lit(None).cast("double").alias("value"))).withColumn("value", F.round("value", 8))


@query(_with() + " SELECT a.t, a.month, grid.pixel_id, round(value, 8) AS value FROM axis a CROSS JOIN grid LEFT JOIN cube ON cube.t = a.t AND cube.pixel_id = grid.pixel_id")
def dense_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.dense(catalog.cube(spark, sf_dir), catalog.grid(spark, sf_dir)).select("t", "month", "pixel_id", F.round("value", 8).alias("value"))


@query(_with(_DETRENDED) + " SELECT t, pixel_id, round(value, 8) AS value FROM detrended")
def detrend_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.detrend(catalog.cube(spark, sf_dir)).select("t", "pixel_id", F.round("value", 8).alias("value"))


@query(_with(_CLIM) + " SELECT month, pixel_id, round(clim, 8) AS clim FROM clim")
def climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.climatology(catalog.cube(spark, sf_dir)).select("month", "pixel_id", F.round("clim", 8).alias("clim"))


@query(_with(_CLIM) + " SELECT t, cube.pixel_id, round(value - clim, 8) AS value FROM cube LEFT JOIN clim ON clim.month = cube.month AND clim.pixel_id = cube.pixel_id")
def anomaly_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = catalog.cube(spark, sf_dir)
    return c.anomalies(x, c.climatology(x)).select("t", "pixel_id", F.round("value", 8).alias("value"))


def _minmax_sql(source: str, fill: str) -> str:
    return f" SELECT t, pixel_id, round(CASE WHEN low IS NULL THEN NULL WHEN value IS NULL THEN {fill} WHEN high > low THEN (value - low) / (high - low) ELSE 0.5 END, 8) AS value FROM (SELECT *, min(value) OVER (PARTITION BY pixel_id) AS low, max(value) OVER (PARTITION BY pixel_id) AS high FROM ({source}))"


_DENSE = "SELECT a.t, a.month, grid.pixel_id, value FROM axis a CROSS JOIN grid LEFT JOIN cube ON cube.t = a.t AND cube.pixel_id = grid.pixel_id WHERE a.month IN (10, 11, 12, 1, 2, 3)"


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.season_filter(c.dense(catalog.cube(spark, sf_dir), catalog.grid(spark, sf_dir)))


@query(_with() + _minmax_sql(_DENSE, "0.5"))
def minmax_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.minmax(_dense(spark, sf_dir)).select("t", "pixel_id", F.round("value", 8).alias("value"))


@query(_with() + _minmax_sql(_DENSE, "NULL"))
def minmax_pixel_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.minmax(_dense(spark, sf_dir), fill_gaps=False).select("t", "pixel_id", F.round("value", 8).alias("value"))


_PREPARED = "SELECT d.t, d.month, d.pixel_id, d.value - k.clim AS value FROM detrended d JOIN (SELECT month, pixel_id, avg(value) AS clim FROM detrended GROUP BY month, pixel_id) k ON k.month = d.month AND k.pixel_id = d.pixel_id WHERE d.month IN (10, 11, 12, 1, 2, 3)"


@query(_with(_DETRENDED) + _minmax_sql(_PREPARED, "0.5").replace(", 8)", ", 6)"))
def preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = catalog.cube(spark, sf_dir)
    return c.preprocess(x, c.climatology(c.detrend(x))).select("t", "pixel_id", F.round("value", 6).alias("value"))


@query(
    _with(_CLIM, "target AS (SELECT CAST(n AS INTEGER) AS pixel_id, (n // 9) * 0.5 AS lat, (n % 9) * 0.5 AS lon FROM range(81) AS r(n))",
          "corner AS (SELECT t.pixel_id, grid.pixel_id AS from_id, greatest(0, 1 - abs(t.lat - grid.iy)) * greatest(0, 1 - abs(t.lon - grid.ix)) AS w FROM target t JOIN grid ON abs(t.lat - grid.iy) < 1 AND abs(t.lon - grid.ix) < 1)")
    + " SELECT month, corner.pixel_id, CASE WHEN abs(sum(w) - 1) < 1e-9 THEN round(sum(w * clim), 8) END AS value FROM corner JOIN clim ON clim.pixel_id = from_id GROUP BY month, corner.pixel_id"
)
def regrid_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    target = spark.range(81).select(n.cast("int").alias("pixel_id"), F.floor(n / 9).cast("int").alias("iy"), (n % 9).cast("int").alias("ix"), (F.floor(n / 9) * 0.5).alias("lat"), ((n % 9) * 0.5).alias("lon"))
    clim = c.climatology(catalog.cube(spark, sf_dir)).withColumnRenamed("clim", "value")
    return c.regrid(clim, catalog.grid(spark, sf_dir), target).select("month", "pixel_id", F.round("value", 8).alias("value"))


@query(_with(BMU_SQL, _CLIM) + " SELECT node, cube.pixel_id, round(greatest(-0.2, least(0.2, avg(value - clim))), 8) AS value FROM cube JOIN clim ON clim.month = cube.month AND clim.pixel_id = cube.pixel_id JOIN bmu ON bmu.t = cube.t GROUP BY node, cube.pixel_id")
def node_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = catalog.cube(spark, sf_dir)
    return c.composite(c.anomalies(x, c.climatology(x)), catalog.bmu(spark, sf_dir), 0.2).select("node", "pixel_id", F.round("value", 8).alias("value"))


@query(_with(BMU_SQL, "r AS (SELECT pixel_id, min(value) AS low, max(value) AS high FROM cube GROUP BY pixel_id)", "p AS (SELECT node, cube.pixel_id, avg(CASE WHEN high > low THEN (value - low) / (high - low) ELSE 0.5 END) AS value FROM cube JOIN r ON r.pixel_id = cube.pixel_id JOIN bmu ON bmu.t = cube.t GROUP BY node, cube.pixel_id)") + " SELECT node, p.pixel_id, round(value * (high - low) + low, 8) AS value FROM p JOIN r ON r.pixel_id = p.pixel_id")
def prototype_denorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = catalog.cube(spark, sf_dir)
    prototypes = c.composite(c.minmax(x), catalog.bmu(spark, sf_dir))
    return c.denormalise(prototypes, c.ranges(x)).select("node", "pixel_id", F.round("value", 8).alias("value"))
