"""Whitened rows against NumPy on the whole matrix."""

from __future__ import annotations

import math

import numpy as np
import pytest

from fieldloom.llm import whitening


def plain(vectors):
    x = np.array([[math.floor(64.0 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    apart = n * x - sums
    centred = apart.astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, (apart * apart).sum(axis=1), centred, values[::-1], axes[:, ::-1]


def check(found, rows, components=32):
    ids, vectors = zip(*rows, strict=True)
    n, deviations, centred, values, axes = plain(vectors)
    width = min(components, centred.shape[1])
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(found) == n * width
    z = np.array([[by[i][c + 1]["whitened"] for c in range(width)] for i in ids])
    for i, d in zip(ids, deviations, strict=True):
        assert {r["deviation"] for r in by[i].values()} == {d} and {r["n"] for r in by[i].values()} == {n}
    explained = [by[ids[0]][c + 1]["explained"] for c in range(width)]
    assert np.allclose(explained, values[:width] / values.sum(), rtol=1e-6)
    expected = centred @ axes[:, :width] / np.sqrt(values[:width])
    signs = np.sign((z * expected).sum(axis=0))
    assert np.allclose(z, expected * signs, atol=1e-6)
    error = np.abs(np.cov(z.T, bias=True) - np.eye(width)).max()
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]} and found[0]["identity_error"] <= 1e-4 and abs(error - found[0]["identity_error"]) < 1e-9


def test_given_embeddings(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    check(whitening.whitened(rows).collect(), [(r["vec_id"], r["embedding"]) for r in rows.collect()])


@pytest.mark.parametrize(("size", "n"), [(3, 400), (40, 300)])
def test_small_blocks(spark, monkeypatch, size, n):
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", size * 16)
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.normal(size=size) * (1 + np.arange(size)) + 50).tolist()) for i in range(n)]
    check(whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect(), rows)


def test_faulty_vectors_are_left_out(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=4).tolist()) for i in range(50)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [1.0, math.nan, 2.0, 3.0]), (104, [math.inf, 1.0, 2.0, 3.0]), (105, [1.0]), (106, [1.0] * 5)]
    found = whitening.whitened(spark.createDataFrame([(*r, 1) for r in good + bad], "vec_id long, embedding array<float>, component int")).collect()
    check(found, [(i, np.float32(v)) for i, v in good])


def test_extremes(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], schema)).collect() == []
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, None, 0.0), (2, 1, 0, None, None, 0.0)]
    flat = whitening.whitened(spark.createDataFrame([(None, [float(i), 2.0 * i, 5.0]) for i in range(10)] * 2, schema)).collect()
    assert len(flat) == 60 and all((r["whitened"] is None) == (r["component"] > 1) for r in flat) and flat[0]["identity_error"] < 1e-9
    wide = whitening.whitened(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 1.0]), (3, [1e6, 0.0])], schema)).collect()
    assert {r["deviation"] for r in wide if r["vec_id"] == 1} == {None} and len(wide) == 6
    large = whitening.whitened(spark.createDataFrame([(1, [3e5, 1.0]), (2, [0.0, 1.0])], schema)).collect()
    assert {r["deviation"] for r in large} == {(64 * 300_000) ** 2}
