"""Sliding-window structural similarity of masked fields.

A Gaussian window is separable and its mirrored border is linear, so the normalised convolution of a whole stack of fields is
two matrix products. What a map's training needs follows from that linearity: when a prototype moves towards a
field, the convolutions of the prototype and of its square move by known combinations (`Stack.move`), and only the
convolution of the product is new.

As in the pipeline that this follows, the mean runs over every cell of the rectangle: a window without any valid cell has
means of zero and scores nearly one. `valid_only` averages over valid cells instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TINY, LEAST_WEIGHT = 1e-12, 1e-10
#: Cells of the stacks that are convolved at once.
CELLS = 1_000_000


def gaussian(size: int = 11, sigma: float = 1.5) -> np.ndarray:
    """One factor of the separable window, with sum 1."""
    if int(size) != size or size % 2 != 1 or size < 1:
        raise ValueError("the window's size must be odd")
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2.0 * sigma**2))
    return k / k.sum()


def band(n: int, kernel: np.ndarray) -> np.ndarray:
    """The n x n matrix that convolves along one axis; beyond an edge the field is mirrored, edge cell included."""
    half, out = len(kernel) // 2, np.zeros((n, n))
    for k, weight in enumerate(kernel):
        at = np.arange(n) + k - half
        period = at % (2 * n)
        np.add.at(out, (np.arange(n), np.where(period < n, period, 2 * n - 1 - period)), weight)
    return out


class Window:
    def __init__(self, mask: np.ndarray, size: int = 11, sigma: float = 1.5, dynamic_range: float = 1.0, k1: float = 0.01, k2: float = 0.03, valid_only: bool = False):
        kernel = gaussian(size, sigma)
        self.mask, self.valid_only = mask, valid_only
        self.rows, self.columns = band(mask.shape[0], kernel), band(mask.shape[1], kernel).T
        weight = self.raw(mask.astype(float))
        weight = np.where(weight > 0, weight, 1.0)
        self.scale = np.where(weight > LEAST_WEIGHT, 1 / weight, np.nan)
        self.c1, self.c2 = (k1 * dynamic_range) ** 2, (k2 * dynamic_range) ** 2

    def raw(self, image: np.ndarray) -> np.ndarray:
        return self.rows @ image @ self.columns

    def mean(self, image: np.ndarray) -> np.ndarray:
        """Weighted means of the valid cells in each window, of a field or a stack of fields without gaps."""
        return self.raw(np.where(self.mask, image, 0.0)) * self.scale

    def ssim(self, m1, m2, s1, s2, s12) -> np.ndarray:
        """From the window means of both fields, of their squares and of their product."""
        p = m1 * m2
        value = (2 * p + self.c1) * (2 * (s12 - p) + self.c2) / ((m1 * m1 + m2 * m2 + self.c1) * (s1 - m1 * m1 + s2 - m2 * m2 + self.c2) + TINY)
        good = ~np.isnan(value)
        if self.valid_only:
            good &= self.mask
        n = good.sum(axis=(-2, -1))
        return np.where(n > 0, np.where(good, value, 0.0).sum(axis=(-2, -1)) / np.maximum(n, 1), 0.0)

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Mean structural similarity of two fields, or of stacks of them."""
        return self.ssim(self.mean(a), self.mean(b), self.mean(a * a), self.mean(b * b), self.mean(a * b))


class Stack:
    """Prototypes with their window means, kept up to date as they move."""

    def __init__(self, window: Window, images: np.ndarray):
        self.window, self.images = window, np.where(window.mask, images, 0.0)
        self.m, self.s = window.mean(self.images), window.mean(self.images**2)

    def distances(self, image: np.ndarray, m: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """1 - similarity to a field whose window means are m and s, and the products' means."""
        product = self.window.mean(self.images * image)
        return 1.0 - self.window.ssim(m, self.m, s, self.s, product), product

    def move(self, image: np.ndarray, m: np.ndarray, s: np.ndarray, product: np.ndarray, step: np.ndarray) -> None:
        """Every prototype goes its own step towards the field."""
        a = step[:, None, None]
        self.s = (1 - a) ** 2 * self.s + 2 * a * (1 - a) * product + a * a * s
        self.m = (1 - a) * self.m + a * m
        self.images = self.images + a * (image - self.images)


def sliding_ssim(pairs: DataFrame, shape: tuple[int, int], mask: np.ndarray | None = None, **options) -> DataFrame:
    """pairs: t, node, vec, w -> t, node, ssim. Vectors hold the mask's valid cells in row-major order. A pair with a null
    element gets null."""
    mask = np.ones(shape, bool) if mask is None else mask

    step = max(1, CELLS // mask.size)

    def images(vectors) -> np.ndarray:
        out = np.zeros((len(vectors), *shape))
        out[:, mask] = np.stack(vectors)
        return out

    def score(batches: Iterator) -> Iterator:
        import pandas as pd

        window = Window(mask, **options)
        for b in batches:
            out = np.full(len(b), np.nan)
            whole = [k for k, (x, w) in enumerate(zip(b["vec"], b["w"], strict=True)) if x is not None and w is not None and not np.isnan(np.asarray(x, float)).any() and not np.isnan(np.asarray(w, float)).any()]
            for at in range(0, len(whole), step):
                k = whole[at : at + step]
                out[k] = window.similarity(images(b["vec"].iloc[k].tolist()), images(b["w"].iloc[k].tolist()))
            yield pd.DataFrame({"t": b["t"], "node": b["node"], "ssim": pd.array([None if np.isnan(v) else v for v in out], dtype="Float64")})

    return pairs.select("t", "node", "vec", "w").mapInPandas(score, "t long, node int, ssim double")


def sliding_coherence(pairs: DataFrame, shape: tuple[int, int], **options) -> DataFrame:
    scored = sliding_ssim(pairs, shape, **options)
    by_node = scored.groupBy("node").agg(F.avg("ssim").alias("m"), F.sum("ssim").alias("s"), F.count("ssim").alias("k"))
    return by_node.agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("node_mean"), F.coalesce(F.try_divide(F.sum("s"), F.sum("k")), F.lit(0.0)).alias("global_mean"))
