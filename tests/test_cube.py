from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions.metrics import clip
from fieldloom.operators import cube as c

SCHEMA = "t int, month int, pixel_id int, value double"


def values(df):
    return {(r["t"], r["pixel_id"]): r["value"] for r in df.collect()}


def test_detrending_a_line_leaves_zero(spark):
    rows = [(t, t % 12 + 1, p, 3.0 * t * p + 7.0) for t in range(10) for p in (1, 2)]
    assert all(abs(v) < 1e-9 for v in values(c.detrend(spark.createDataFrame(rows, SCHEMA))).values())


def test_detrending_ignores_gaps_and_uses_positions(spark):
    series = {0: 1.0, 2: 5.0, 3: None, 7: 2.0, 9: 8.0}
    found = values(c.detrend(spark.createDataFrame([(t, 1, 0, v) for t, v in series.items()], SCHEMA)))
    x = np.array([0, 1, 3, 4])
    y = np.array([1.0, 5.0, 2.0, 8.0])
    slope, intercept = np.polyfit(x, y, 1)
    for (t, v), p in zip(((0, 1.0), (2, 5.0), (7, 2.0), (9, 8.0)), x, strict=True):
        assert found[t, 0] == pytest.approx(v - slope * p - intercept)
    assert found[3, 0] is None


def test_minmax_rules(spark):
    rows = [(0, 1, 0, 2.0), (1, 2, 0, 4.0), (2, 3, 0, 3.0), (0, 1, 1, 5.0), (1, 2, 1, 5.0), (2, 3, 1, 5.0), (0, 1, 2, 1.0), (1, 2, 2, None), (2, 3, 2, 2.0), (0, 1, 3, None), (1, 2, 3, None), (2, 3, 3, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    filled, strict = values(c.minmax(df)), values(c.minmax(df, fill_gaps=False))
    assert [filled[t, 0] for t in range(3)] == [0.0, 1.0, 0.5]
    assert [filled[t, 1] for t in range(3)] == [0.5, 0.5, 0.5] == [strict[t, 1] for t in range(3)]
    assert filled[1, 2] == 0.5 and strict[1, 2] is None
    assert [filled[t, 3] for t in range(3)] == [None] * 3


def test_masks_differ_where_a_pixel_fails_later(spark):
    df = spark.createDataFrame([(0, 1, 0, 1.0), (1, 2, 0, 1.0), (0, 1, 1, 1.0), (1, 2, 1, None), (1, 2, 2, 4.0)], SCHEMA)
    ids = lambda rule: sorted(r["pixel_id"] for r in c.mask(df, rule).collect())
    assert ids("all_times") == [0]
    assert ids("first_step") == [0, 1]
    with pytest.raises(ValueError, match="unknown"):
        c.mask(df, "some")


def test_gather_and_scatter_are_inverse(spark):
    grid = spark.createDataFrame([(p, p // 3, p % 3, float(p // 3), float(p % 3)) for p in range(9)], "pixel_id int, iy int, ix int, lat double, lon double")
    df = spark.createDataFrame([(t, 1, p, 10.0 * t + p) for t in range(2) for p in (7, 1, 4)], SCHEMA)
    places = c.positions(c.mask(df), grid)
    back = values(c.scatter(c.gather(df, places), places, grid))
    assert back == {(t, p): (10.0 * t + p if p in (1, 4, 7) else None) for t in range(2) for p in range(9)}


def test_clip_keeps_nulls(spark):
    df = spark.createDataFrame([(None,), (-3.0,), (0.4,), (9.0,)], "x double").select(clip(F.col("x"), 0.0, 1.0).alias("y"))
    assert [r["y"] for r in df.collect()] == [None, 0.0, 0.4, 1.0]


def test_regrid_stays_inside_the_hull(spark):
    schema = "pixel_id int, iy int, ix int, lat double, lon double"
    source = spark.createDataFrame([(0, 0, 0, 10.0, 0.0), (1, 0, 1, 10.0, 2.0), (2, 1, 0, 0.0, 0.0), (3, 1, 1, 0.0, 2.0)], schema)
    target = spark.createDataFrame([(0, 0, 0, 5.0, 1.0), (1, 0, 1, 5.0, 2.0), (2, 1, 0, 12.0, 1.0), (3, 1, 1, 10.0, 0.0)], schema)
    data = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (1, 2, 5.0), (1, 3, 7.0)], "month int, pixel_id int, value double")
    target = spark.createDataFrame([(0, 0, 0, 5.0, 1.0), (1, 1, 1, 10.0, 2.0)], schema)
    found = {r["pixel_id"]: r["value"] for r in c.regrid(data, source, target).collect()}
    assert found == {0: pytest.approx(4.0), 1: pytest.approx(3.0)}
    outside = spark.createDataFrame([(0, 0, 0, 12.0, 1.0)], schema)
    assert c.regrid(data, source, outside).collect() == []
