"""Hypothesis tests. Statistics are aggregates; p-values come from distributions that Spark's own class path offers."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _distribution(spark: SparkSession, name: str, *parameters: float):
    return getattr(spark._jvm.org.apache.commons.math3.distribution, name)(*map(float, parameters))


def upper_f(spark: SparkSession, f: float, df1: float, df2: float) -> float:
    return 1.0 - _distribution(spark, "FDistribution", df1, df2).cumulativeProbability(float(f))


def upper_chi2(spark: SparkSession, x: float, df: float) -> float:
    return 1.0 - _distribution(spark, "ChiSquaredDistribution", df).cumulativeProbability(float(x))


def two_sided_t(spark: SparkSession, r: float, n: int) -> float:
    """p of a correlation r of n pairs."""
    if n < 3:
        return math.nan
    if abs(r) >= 1:
        return 0.0
    t = abs(r) * math.sqrt((n - 2) / (1 - r * r))
    return 2 * (1.0 - _distribution(spark, "TDistribution", n - 2).cumulativeProbability(t))


def _between_within(x: DataFrame) -> DataFrame:
    """x: g, v -> f, df1, df2."""
    by = x.groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("*")).alias("w"))
    total = by.agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.count("*").alias("k"), F.sum("w").alias("within"))
    y = by.join(F.broadcast(total))
    y = y.agg(F.sum(F.col("n") * (F.col("m") - F.col("grand")) * (F.col("m") - F.col("grand"))).alias("between"), F.first("within").alias("within"), F.first("k").alias("k"), F.first("total").alias("total"))
    f = F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("total") - F.col("k")))
    return y.filter("k > 1 and total > k").select(f.alias("statistic"), (F.col("k") - 1).alias("df1"), (F.col("total") - F.col("k")).alias("df2"))


def _named(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("g is not null and v is not null")


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    return _between_within(_named(df, group, value))


def levene(df: DataFrame, group: str, value: str) -> DataFrame:
    """With the median as centre (Brown-Forsythe)."""
    x = _named(df, group, value)
    centre = x.groupBy("g").agg(F.median("v").alias("c"))
    return _between_within(x.join(centre, "g").select("g", F.abs(F.col("v") - F.col("c")).alias("v")))


#: Rows whose distinct values one task ranks, about, and the number of ranges at most.
IN_RANGE, RANGES, FAN = 50_000, 1_024, 64


def bounds_of(values: DataFrame, value: str) -> list[float]:
    """Values that cut the rows into about equal parts, as many as IN_RANGE asks for, in one pass without a shuffle: fixed numbers, so that
    whatever runs again cuts alike. A part has no more distinct values than rows, and equal rows are never parted."""
    n, cuts = values.select(F.count(value), F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], RANGES * 10)).first()
    parts = min(RANGES, -(-n // IN_RANGE))
    return sorted({cuts[RANGES * k // parts - 1] for k in range(1, parts)})


def place_among(value: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are at or below the value: a tree of comparisons down to FAN groups, and a count inside the group."""

    def below(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        if len(bounds) > FAN and high - low < max(2, len(bounds) // FAN):
            return F.lit(low) + F.size(F.filter(F.array(*map(F.lit, bounds[low:high])), lambda b: b <= value))
        middle = (low + high) // 2
        return F.when(value < bounds[middle], below(low, middle)).otherwise(below(middle + 1, high))

    return below(0, len(bounds))


def rank_table(values: DataFrame, value: str = "v") -> DataFrame:
    """Distinct values with `rank`, ties at their mean, and `ties`. Counts of distinct values are aggregated first; a running sum goes over
    the totals of their ranges, and over the distinct values inside each."""
    counts = values.groupBy(value).agg(F.count("*").alias("ties"))
    parts = counts.withColumn("part", place_among(F.col(value), bounds_of(values, value)))
    totals = parts.groupBy("part").agg(F.sum("ties").alias("n"))
    ahead = totals.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = W.partitionBy("part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranked = parts.withColumn("below", F.coalesce(F.sum("ties").over(inside), F.lit(0))).join(ahead, "part")
    return ranked.select(F.col(value), "ties", (F.col("ahead") + F.col("below") + (F.col("ties") + 1) / 2.0).alias("rank"))


def average_ranks(values: DataFrame, value: str = "v") -> DataFrame:
    """Adds `rank` with ties at their mean, and `ties`."""
    return values.join(rank_table(values, value), value)


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """Tie-corrected H and its degrees of freedom."""
    x = average_ranks(_named(df, group, value))
    by = x.groupBy("g").agg(F.sum("rank").alias("r"), F.count("*").alias("n"), F.sum((F.col("ties") * F.col("ties") - 1).cast("double")).alias("tie"))
    n = F.sum("n")
    y = by.agg(n.alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("tie").alias("tie"), F.count("*").alias("k"))
    h = 12.0 / (F.col("n") * (F.col("n") + 1)) * F.col("s") - 3 * (F.col("n") + 1)
    correction = 1 - F.col("tie") / (F.col("n").cast("double") * (F.col("n") * F.col("n") - 1))
    return y.select(F.try_divide(h, F.nullif(correction, F.lit(0.0))).alias("statistic"), (F.col("k") - 1).alias("df"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """r and n; null where a column is constant."""
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null")
    spread = F.sqrt(F.var_pop("x") * F.var_pop("y"))
    return d.agg(F.try_divide(F.covar_pop("x", "y"), F.nullif(spread, F.lit(0.0))).alias("r"), F.count("*").alias("n"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null")
    rx, ry = (rank_table(d, c).select(c, F.col("rank").alias(f"r{c}")) for c in "xy")
    return pearson(d.join(rx, "x").join(ry, "y"), "rx", "ry")


# Royston's polynomials (AS R94), constant term first.
_C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_MEAN, _SMALL_SCALE = (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN, _LARGE_SCALE = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
_GAMMA = (-2.273, 0.459)
MAX_SHAPIRO = 5000


def _poly(c: tuple[float, ...], x: float) -> float:
    return sum(a * x**k for k, a in enumerate(c))


def shapiro(values: list[float]) -> tuple[float, float]:
    """Shapiro-Wilk W and p of 3 to MAX_SHAPIRO values; constant values give (1, 1)."""
    x = sorted(values)
    n = len(x)
    if not 3 <= n <= MAX_SHAPIRO:
        raise ValueError(f"Shapiro-Wilk takes 3 to {MAX_SHAPIRO} values")
    mean = math.fsum(x) / n
    spread = math.fsum((v - mean) ** 2 for v in x)
    if spread == 0:
        return 1.0, 1.0
    if n == 3:
        weights = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        m = [NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
        mm, u = math.fsum(v * v for v in m), 1 / math.sqrt(n)
        last = m[-1] / math.sqrt(mm) + _poly(_C1, u)
        if n > 5:
            second = m[-2] / math.sqrt(mm) + _poly(_C2, u)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            ends = [second, last]
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            ends = [last]
        k = len(ends)
        weights = [-e for e in reversed(ends)] + [v / math.sqrt(phi) for v in m[k:-k]] + ends
    w = min(1.0, math.fsum(a * v for a, v in zip(weights, x, strict=True)) ** 2 / spread)
    if n == 3:
        return w, min(1.0, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if w == 1.0:
        return w, 1.0
    if n <= 11:
        gap = _poly(_GAMMA, n) - math.log(1 - w)
        if gap <= 0:
            return w, 0.0
        z = (-math.log(gap) - _poly(_SMALL_MEAN, n)) / math.exp(_poly(_SMALL_SCALE, n))
    else:
        z = (math.log(1 - w) - _poly(_LARGE_MEAN, math.log(n))) / math.exp(_poly(_LARGE_SCALE, math.log(n)))
    return w, 1 - NormalDist().cdf(z)


def phase_tests(seasons: DataFrame, order: tuple[str, ...] = ("El Niño", "Neutral", "La Niña")) -> DataFrame:
    """seasons: season_year, mean_index, oni, phase -> one row of all tests; a test without enough values is null."""
    spark = seasons.sparkSession
    d = seasons.filter(F.col("phase").isin(*order))
    names = ("el_nino", "neutral", "la_nina")
    out: dict[str, float | int | None] = {}
    limits = {r["phase"]: r["n"] for r in d.groupBy("phase").agg(F.count("*").alias("n")).collect()}
    for phase, name in zip(order, names, strict=True):
        out[f"n_{name}"] = limits.get(phase, 0)
    for phase, name in zip(order, names, strict=True):
        ok = 3 <= limits.get(phase, 0) <= MAX_SHAPIRO
        out[f"shapiro_p_{name}"] = shapiro([r[0] for r in d.filter(F.col("phase") == phase).select("mean_index").collect()])[1] if ok else None
    first = lambda df: (df.collect() or [None])[0]
    a, lv, k = first(anova(d, "phase", "mean_index")), first(levene(d, "phase", "mean_index")), first(kruskal(d, "phase", "mean_index"))
    p, s = first(pearson(seasons, "oni", "mean_index")), first(spearman(seasons, "oni", "mean_index"))
    value = lambda r, c="statistic": None if r is None else r[c]
    out["levene_p"] = upper_f(spark, lv["statistic"], lv["df1"], lv["df2"]) if value(lv) is not None else None
    out["anova_F"], out["anova_p"] = value(a), upper_f(spark, a["statistic"], a["df1"], a["df2"]) if value(a) is not None else None
    out["kruskal_H"], out["kruskal_p"] = value(k), upper_chi2(spark, k["statistic"], k["df"]) if value(k) is not None and k["df"] > 0 else None
    out["pearson_r"], out["pearson_p"] = value(p, "r"), two_sided_t(spark, p["r"], p["n"]) if value(p, "r") is not None else None
    out["spearman_rho"], out["spearman_p"] = value(s, "r"), two_sided_t(spark, s["r"], s["n"]) if value(s, "r") is not None else None
    return spark.range(1).select(*(F.lit(v).cast("int" if c.startswith("n_") else "double").alias(c) for c, v in out.items()))
