from __future__ import annotations

import math

import numpy as np
import pytest

from fieldloom.operators import runs, validity


@pytest.fixture
def small(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (30, 4))
    fields = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "t long, vec array<double>")
    nodes = {"a": [k % 3 for k in range(30)], "b": [0] * 30, "c": [-1 if k % 5 == 0 else k % 4 for k in range(30)], "d": list(range(30))}
    rows = [(r, k, n) for r, own in nodes.items() for k, n in enumerate(own)]
    assignments = spark.createDataFrame(rows, "run_id string, t long, node int")
    sizes = spark.createDataFrame([("a", 3), ("b", 2), ("c", 2), ("d", 6), ("gone", 3)], "run_id string, size int")
    return x, fields, nodes, assignments, sizes


def slow(x, nodes):
    """Both silhouettes, Davies-Bouldin and Calinski-Harabasz by their definitions."""
    keep = [k for k, n in enumerate(nodes) if n >= 0]
    x, nodes = x[keep], np.array([nodes[k] for k in keep])
    own = np.unique(nodes)
    euclid = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    corr = 1 - np.corrcoef(x)

    def silhouette(d):
        out = []
        for k, n in enumerate(nodes):
            same = (nodes == n).sum() - 1
            if not same:
                out.append(0.0)
                continue
            a = d[k][nodes == n].sum() / same
            b = min(d[k][nodes == m].mean() for m in own if m != n)
            out.append((b - a) / max(a, b))
        return np.mean(out)

    centres = np.array([x[nodes == n].mean(0) for n in own])
    spread = [np.sqrt(((x[nodes == n] - c) ** 2).sum(1)).mean() for n, c in zip(own, centres)]
    bouldin = np.mean([max((spread[i] + spread[j]) / np.linalg.norm(centres[i] - centres[j]) for j in range(len(own)) if j != i) for i in range(len(own))])
    between = sum((nodes == n).sum() * ((c - x.mean(0)) ** 2).sum() for n, c in zip(own, centres))
    within = sum(((x[nodes == n] - c) ** 2).sum() for n, c in zip(own, centres))
    return silhouette(euclid), silhouette(corr), bouldin, between / (len(own) - 1) / (within / (len(x) - len(own)))


def test_indices_against_their_definitions(small):
    x, fields, nodes, assignments, sizes = small
    found = {r["run_id"]: r for r in runs.indices_of_runs(fields, assignments, sizes).collect()}
    assert sorted(found) == ["a", "b", "c", "d"]
    for name in ("a", "c"):
        assert [found[name][c] for c in runs.INDICES] == pytest.approx(slow(x, nodes[name]))
        one = validity.indices(fields.join(assignments.filter(f"run_id = '{name}'"), "t"), found[name]["n_nodes_total"]).first()
        for c in ("n_nodes_empty", "max_node_share", "occupancy_entropy", "n_clusters_occupied", *runs.INDICES):
            assert found[name][c] == pytest.approx(one[c])
    assert found["b"]["note"] == validity.NOTE and found["d"]["note"] == ""
    assert all(found[r][c] is None for r in "bd" for c in runs.INDICES)


def test_the_other_rule_for_degenerate_runs(small):
    _, fields, _, assignments, sizes = small
    found = {r["run_id"]: [r[c] for c in runs.INDICES] for r in runs.indices_of_runs(fields, assignments, sizes, degenerate="scores").collect()}
    assert found["b"] == [0.0, 0.0, math.inf, 0.0] and None not in found["a"]


def test_records_name_what_is_missing(small):
    _, fields, _, assignments, sizes = small
    found, gone = runs.records(fields, assignments, sizes, "exploratory")
    assert [r["run_id"] for r in gone.collect()] == ["gone"] and {r["phase"] for r in found.collect()} == {"exploratory"}


def test_lengths_are_checked(small):
    _, fields, _, assignments, _ = small
    short = assignments.filter("run_id <> 'a' or t < 20")
    assert runs.checked_lengths(assignments, fields).count() == 120
    assert {r["run_id"] for r in runs.checked_lengths(short, fields, strict=False).select("run_id").distinct().collect()} == set("bcd")
    with pytest.raises(Exception, match="run a has 20 assignments for 30 fields"):
        runs.checked_lengths(short, fields).collect()


def test_coherence_of_runs(small):
    x, fields, nodes, assignments, sizes = small

    def ssim(a, b):
        c = np.cov(a, b, bias=True)
        return (2 * a.mean() * b.mean() + 1e-4) * (2 * c[0, 1] + 9e-4) / ((a.mean() ** 2 + b.mean() ** 2 + 1e-4) * (c[0, 0] + c[1, 1] + 9e-4))

    found = {r["run_id"]: r["mean_ssim"] for r in runs.coherence_of_runs(fields, assignments).collect()}
    for name in "abc":
        means = []
        for n in set(nodes[name]) - {-1}:
            own = [k for k, m in enumerate(nodes[name]) if m == n]
            means.append(np.mean([ssim(x[i], x[j]) for i in own for j in own if i < j]))
        assert found[name] == pytest.approx(np.mean(means))
    assert found["d"] is None if "d" in found else True
    by = {r["size"]: r for r in runs.coherence_by_size(runs.coherence_of_runs(fields, assignments), sizes).collect()}
    assert by[2]["n_runs"] == 2 and by[2]["mean_ssim"] == pytest.approx((found["b"] + found["c"]) / 2, abs=1e-4)
