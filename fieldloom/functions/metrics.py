"""Similarity of vectors as Column expressions, from the five sums that all metrics share.

A pair (x, w) is described by the length n and the sums of x, w, x*x, w*w, x*w; sums of one vector are computed once a
row (`with_sums`), so only the product is left for each pair. Moments are population moments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stabilising constants of the structural similarity.
K1, K2 = 0.01, 0.03


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Binds a value for an expression that uses it many times, above all inside a lambda, where Catalyst would inline
    it and compute it once an element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def vector_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return vector_sum(F.zip_with(a, b, lambda x, y: x * y))


def with_sums(df: DataFrame, vec: str = "vec", prefix: str = "") -> DataFrame:
    """Adds {prefix}s1 and {prefix}s2, the sums of a vector and of its squares."""
    return df.withColumn(f"{prefix}s1", vector_sum(F.col(vec))).withColumn(f"{prefix}s2", dot(F.col(vec), F.col(vec)))


def clip(x: Column, low: float, high: float) -> Column:
    """Keeps nulls: least and greatest alone would fill them."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


class Pair:
    """Moments of a pair of vectors."""

    def __init__(self, n: Column, sx: Column, sw: Column, sxx: Column, sww: Column, sxw: Column):
        self.n, self.sxx, self.sww, self.sxw = n.cast("double"), sxx, sww, sxw
        self.mean_x, self.mean_w = sx / self.n, sw / self.n
        self.var_x = F.greatest(F.lit(0.0), sxx / self.n - self.mean_x * self.mean_x)
        self.var_w = F.greatest(F.lit(0.0), sww / self.n - self.mean_w * self.mean_w)
        self.cov = sxw / self.n - self.mean_x * self.mean_w


def euclidean(p: Pair) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), p.sxx + p.sww - 2 * p.sxw))


def squared_euclidean(p: Pair) -> Column:
    return F.greatest(F.lit(0.0), p.sxx + p.sww - 2 * p.sxw)


#: A variance below this share of the mean square is rounding, so the vector is constant.
FLAT = 1e-14


def constant(p: Pair) -> Column:
    return (p.var_x <= FLAT * p.sxx / p.n) | (p.var_w <= FLAT * p.sww / p.n)


def correlation(p: Pair) -> Column:
    """One minus the Pearson correlation; 1 where a vector is constant."""
    return F.when(constant(p), F.lit(1.0)).otherwise(1 - F.try_divide(p.cov, F.sqrt(p.var_x * p.var_w)))


def ssim(p: Pair, dynamic_range: float = 1.0, guarded: bool = False) -> Column:
    """Global structural similarity; guarded: null where a vector is constant."""
    c1, c2 = (K1 * dynamic_range) ** 2, (K2 * dynamic_range) ** 2
    value = ((2 * p.mean_x * p.mean_w + c1) * (2 * p.cov + c2)) / ((p.mean_x * p.mean_x + p.mean_w * p.mean_w + c1) * (p.var_x + p.var_w + c2))
    return F.when(~constant(p), value) if guarded else value


def ssim_distance(p: Pair) -> Column:
    return -ssim(p)


METRICS: dict[str, Callable[[Pair], Column]] = {"euclidean": euclidean, "squared_euclidean": squared_euclidean, "correlation": correlation, "ssim": ssim_distance}


def metric(name: str) -> Callable[[Pair], Column]:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name}; known: {', '.join(METRICS)}")
    return METRICS[name]
