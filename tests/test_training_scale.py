"""Trainings of many fields or many cells: principal axes from the smaller side, one task a stack of runs."""

from __future__ import annotations

import time
import tracemalloc

import numpy as np
import pytest

from fieldloom.operators import som


def axes_by_svd(x, n=2):
    return som.signed(np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:n])


@pytest.mark.parametrize("shape", [(50, 12), (12, 50), (30, 30)])
def test_axes_of_either_side(shape, monkeypatch):
    x = np.random.default_rng(1).normal(size=shape) * (1 + np.arange(shape[1])[::-1])
    assert np.allclose(som.principal(x)[1], axes_by_svd(x), atol=1e-8)
    monkeypatch.setattr(som, "GRAM", 5)
    assert np.allclose(som.principal(x)[1], axes_by_svd(x), atol=1e-6)


def test_flat_data_have_no_axes():
    assert not som.principal(np.ones((6, 4)))[1].any() and not som.principal(np.ones((4, 6)))[1].any()
    line = np.outer(np.arange(8.0), [1.0, 2.0, 2.0])
    assert np.allclose(som.principal(line)[1], [[1 / 3, 2 / 3, 2 / 3], [0, 0, 0]])


def test_many_fields_take_little_time_and_memory():
    x = np.random.default_rng(2).normal(size=(100_000, 64)) * np.linspace(2, 1, 64)
    som.principal(x[:1000])
    tracemalloc.start()
    began = time.perf_counter()
    found = som.principal(x)[1]
    took, most = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 5 and most < 1 << 30
    assert np.allclose(found, axes_by_svd(x), atol=1e-6)


def test_axes_from_a_distributed_table(spark):
    x = np.random.default_rng(3).normal(size=(200, 20)) * np.linspace(5, 1, 20)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, [None] * 20)]
    mean, axes = som.principal_of(spark.createDataFrame(rows, "t int, vec array<double>").repartition(5))
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(axes, axes_by_svd(x), atol=1e-6)


def test_a_stack_of_maps_is_its_maps():
    x = np.random.default_rng(4).random((40, 9))
    for search in som.SEARCHES:
        for start in som.STARTS:
            both = som.exploratory_stack(x, 3, search, start, [1, 10, 22], 300)
            assert all(np.array_equal(w, som.exploratory_train(x, 3, search, start, seed, 300)) for w, seed in zip(both, [1, 10, 22], strict=True))


def test_drawing_at_once_is_drawing_step_by_step():
    one, many = np.random.RandomState(77), np.random.RandomState(77)
    assert [one.randint(0, 264) for _ in range(1000)] == many.randint(0, 264, 1000).tolist()


def test_stacks_are_spread_over_tasks(spark):
    from pyspark.sql import functions as F

    fields = spark.createDataFrame([(t, [float(t % 5), float(t % 3), 1.0]) for t in range(30)], "t long, vec array<double>")
    found = som.train_runs(som.runs(spark), fields, 20)
    parts = found.groupBy(F.spark_partition_id().alias("part")).agg(F.count_distinct("run_id").alias("n")).collect()
    assert sum(r["n"] for r in parts) == 216 and len(parts) == 36 and max(r["n"] for r in parts) == som.STACK
    assert som.train_runs(som.runs(spark), fields.filter("t < 0"), 20).count() == 0


def test_final_training_over_many_fields():
    """One epoch over 20,000 fields; the start alone took a matrix of fields x fields before."""
    x = np.random.default_rng(5).random((20_000, 64))
    tracemalloc.start()
    began = time.perf_counter()
    _, nodes = som.final_train(x, som.FinalConfig(epochs=1), np.ones((8, 8), bool))
    took, most = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(nodes) == 20_000 and nodes.min() >= 0 and most < 1 << 30 and took < 60
