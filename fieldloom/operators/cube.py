"""Gridded monthly series in long form: cube(t, month, pixel_id, value), grid(pixel_id, iy, ix, lat, lon).

A missing value is a null or an absent row. Everything is grouped by pixel_id, so one exchange on it serves trend, range
and normalisation alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions.calendar import WARM_MONTHS, in_season
from fieldloom.functions.metrics import clip


def nan_to_null(df: DataFrame, column: str = "value") -> DataFrame:
    return df.withColumn(column, F.when(~F.isnan(column), F.col(column)))


def time_axis(cube: DataFrame) -> DataFrame:
    """Distinct times with a position 0, 1, ... in their order; one row a month, so its one window is small."""
    own = [c for c in ("time", "year", "month") if c in cube.columns]
    return cube.select("t", *own).distinct().withColumn("pos", F.row_number().over(W.orderBy("t")) - 1)


def season_filter(cube: DataFrame, months: tuple[int, ...] = WARM_MONTHS) -> DataFrame:
    return cube.filter(in_season(F.col("month"), months))


def n_times(cube: DataFrame) -> DataFrame:
    return cube.agg(F.count_distinct("t").alias("n_times"))


def mask(cube: DataFrame, rule: str = "all_times") -> DataFrame:
    """Valid pixels. all_times: a value in every month of the cube; first_step: in its first month."""
    if rule == "all_times":
        counts = cube.groupBy("pixel_id").agg(F.count_distinct(F.when(F.col("value").isNotNull(), F.col("t"))).alias("n"))
        return counts.join(F.broadcast(n_times(cube)), F.col("n") == F.col("n_times")).select("pixel_id")
    if rule == "first_step":
        first = cube.agg(F.min("t").alias("t"))
        return cube.filter(F.col("value").isNotNull()).join(first, "t", "left_semi").select("pixel_id").distinct()
    raise ValueError(f"unknown mask rule {rule}")


def positions(mask_: DataFrame, grid: DataFrame) -> DataFrame:
    """The place of each valid pixel in a vector: row-major order of the grid, a bounded dimension table."""
    return grid.join(mask_, "pixel_id", "left_semi").withColumn("pos", F.row_number().over(W.orderBy("iy", "ix")) - 1)


def ocean(cube: DataFrame, grid: DataFrame) -> DataFrame:
    """Pixels without any value."""
    top = cube.groupBy("pixel_id").agg(F.max("value").alias("top"))
    return grid.join(top, "pixel_id", "left").filter("top is null").select("pixel_id")


def gather(cube: DataFrame, places: DataFrame) -> DataFrame:
    """t, vec: the values of each month in vector order."""
    kept = cube.join(places.select("pixel_id", "pos"), "pixel_id")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return kept.groupBy("t").agg(F.transform(ordered, lambda x: x["value"]).alias("vec"))


def scatter(vectors: DataFrame, places: DataFrame, grid: DataFrame, key: str = "t") -> DataFrame:
    """Back to pixels; those outside the mask get null."""
    long = vectors.select(key, F.posexplode("vec").alias("pos", "value"))
    every = vectors.select(key).distinct().select(key, F.lit(1).alias("one")).join(F.broadcast(grid.withColumn("one", F.lit(1))), "one").drop("one")
    located = every.join(places.select("pixel_id", "pos"), "pixel_id", "left")
    return located.join(long, [key, "pos"], "left").select(key, "pixel_id", "iy", "ix", "value")


def detrend(cube: DataFrame) -> DataFrame:
    """Subtracts each pixel's least-squares line against the position in time; nulls stay out of the fit. A pixel with a
    single value has no line and gets null."""
    placed = cube.join(time_axis(cube).select("t", "pos"), "t")
    own = W.partitionBy("pixel_id")
    x = F.when(F.col("value").isNotNull(), F.col("pos").cast("double"))
    slope = F.try_divide(F.covar_pop(x, F.col("value")).over(own), F.var_pop(x).over(own))
    placed = placed.withColumn("slope", slope).withColumn("mean_x", F.avg(x).over(own)).withColumn("mean_v", F.avg("value").over(own))
    line = F.col("mean_v") + F.col("slope") * (F.col("pos") - F.col("mean_x"))
    return placed.withColumn("value", F.col("value") - line).drop("pos", "slope", "mean_x", "mean_v")


def climatology(cube: DataFrame) -> DataFrame:
    return cube.groupBy("month", "pixel_id").agg(F.avg("value").alias("clim"))


def anomalies(cube: DataFrame, clim: DataFrame) -> DataFrame:
    """Value minus the climatology of its calendar month; null where that has none."""
    joined = cube.join(clim, ["month", "pixel_id"], "left")
    return joined.withColumn("value", F.col("value") - F.col("clim")).drop("clim")


def minmax(cube: DataFrame, fill_gaps: bool = True) -> DataFrame:
    """Rescales each pixel to [0, 1] over its own range. A pixel without range gets 0.5; with fill_gaps so does every
    gap of a pixel that has any value. Pixels without values stay null."""
    own = W.partitionBy("pixel_id")
    low, high = F.min("value").over(own), F.max("value").over(own)
    scaled = F.try_divide(F.col("value") - low, F.nullif(high - low, F.lit(0.0)))
    fill = F.when(low.isNotNull(), F.lit(0.5)) if fill_gaps else F.when(F.col("value").isNotNull(), F.lit(0.5))
    return cube.withColumn("value", clip(F.coalesce(scaled, fill), 0.0, 1.0))


def dense(cube: DataFrame, grid: DataFrame) -> DataFrame:
    """A row for every month and pixel; both axes are dimension tables."""
    axis = cube.select("t", "month").distinct().withColumn("one", F.lit(1))
    every = axis.join(F.broadcast(grid.select("pixel_id").withColumn("one", F.lit(1))), "one").drop("one")
    return every.join(cube.select("t", "pixel_id", "value"), ["t", "pixel_id"], "left")


def _brackets(source: DataFrame, target: DataFrame, axis: str, place: str) -> DataFrame:
    """For each target coordinate the source coordinates around it and the weight of the upper; null outside."""
    s = source.select(F.col(axis).alias("low"), F.col(place).alias("k")).distinct()
    s = s.withColumn("high", F.lead("low").over(W.orderBy("low"))).withColumn("k2", F.lead("k").over(W.orderBy("low")))
    t = target.select(F.col(axis).alias("x"), F.col(place).alias("to")).distinct()
    inside = (F.col("x") >= F.col("low")) & ((F.col("x") < F.col("high")) | F.col("high").isNull() & (F.col("x") == F.col("low")))
    hit = t.join(F.broadcast(s), inside, "left")
    w = F.coalesce((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")), F.lit(0.0))
    return hit.select("to", "k", F.coalesce("k2", "k").alias("k2"), F.when(F.col("k").isNotNull(), w).alias("w"))


def regrid(values: DataFrame, source: DataFrame, target: DataFrame, key: str = "month") -> DataFrame:
    """Bilinear interpolation of (key, pixel_id, value) from one grid to another. Outside the source's hull, or beside a
    missing corner, the result is null."""
    ys, xs = _brackets(source, target, "lat", "iy"), _brackets(source, target, "lon", "ix")
    corner = lambda y, x, w: F.struct(F.col(y).alias("iy"), F.col(x).alias("ix"), w.alias("w"))
    wy, wx = F.col("wy"), F.col("wx")
    t = target.join(ys.toDF("to_y", "y1", "y2", "wy"), F.col("iy") == F.col("to_y")).join(xs.toDF("to_x", "x1", "x2", "wx"), F.col("ix") == F.col("to_x"))
    corners = F.array(corner("y1", "x1", (1 - wy) * (1 - wx)), corner("y1", "x2", (1 - wy) * wx), corner("y2", "x1", wy * (1 - wx)), corner("y2", "x2", wy * wx))
    used = t.select("pixel_id", F.explode(corners).alias("c")).select("pixel_id", "c.*").filter("w > 0")
    at = used.join(source.select(F.col("pixel_id").alias("from_id"), "iy", "ix"), ["iy", "ix"])
    found = values.join(at.withColumnRenamed("pixel_id", "to_id"), F.col("pixel_id") == F.col("from_id"))
    return found.groupBy(key, F.col("to_id").alias("pixel_id")).agg(F.when(F.abs(F.sum(F.when(F.col("value").isNotNull(), F.col("w"))) - 1) < 1e-9, F.sum(F.col("w") * F.col("value"))).alias("value"))


def composite(cube: DataFrame, bmu: DataFrame, limit: float | None = None) -> DataFrame:
    """Mean field of each node's months, per pixel, clipped to +-limit."""
    x = cube.join(bmu.select("t", "node"), "t").groupBy("node", "pixel_id").agg(F.avg("value").alias("value"))
    return x if limit is None else x.withColumn("value", clip(F.col("value"), -limit, limit))


def denormalise(prototypes: DataFrame, ranges: DataFrame, limit: float | None = None) -> DataFrame:
    """(node, pixel_id, value in [0, 1]) with (pixel_id, low, high) back to units."""
    x = prototypes.join(ranges, "pixel_id").withColumn("value", F.col("value") * (F.col("high") - F.col("low")) + F.col("low")).drop("low", "high")
    return x if limit is None else x.withColumn("value", clip(F.col("value"), -limit, limit))


def ranges(cube: DataFrame) -> DataFrame:
    return cube.groupBy("pixel_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def preprocess(cube: DataFrame, clim: DataFrame, months: tuple[int, ...] = WARM_MONTHS) -> DataFrame:
    """Detrend, subtract the climatology, keep the season, rescale."""
    return minmax(season_filter(anomalies(detrend(cube), clim), months))

