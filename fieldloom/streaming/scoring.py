"""Incoming fields against a frozen map: a stateless stream-static join, and occupancy by event-time window. This goes beyond
the batch pipeline, which has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.bmu import assign


def score_stream(fields: DataFrame, prototypes: DataFrame, metric: str = "ssim") -> DataFrame:
    """fields: a stream of t, vec. Works row by row, so it needs no state and any output mode will do."""
    return assign(fields, prototypes, metric)


def occupancy_stream(scored: DataFrame, time: str, window: str, delay: str) -> DataFrame:
    """Counts of nodes by event-time window; rows later than `delay` are dropped with the window's state."""
    return scored.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.window(time, window), "node").agg(F.count("*").alias("n"))
