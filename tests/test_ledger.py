"""Saved runs, found and evaluated once; fingerprints of inputs; ranks in ranges."""

from __future__ import annotations

import os

import numpy as np
import pytest

from fieldloom.operators import ledger, runs, stats
from fieldloom.plans import comparison
from fieldloom.sources import saved, sinks


@pytest.fixture
def fields(spark, tmp_path):
    x = np.random.default_rng(1).normal(0, 1, (24, 5))
    df = spark.createDataFrame([(10 * k, v.tolist()) for k, v in enumerate(x)], "t long, vec array<double>")
    df.write.parquet(str(tmp_path / "fields"))
    return spark.read.parquet(str(tmp_path / "fields"))


def save(folder, nodes, columns, config):
    os.makedirs(folder, exist_ok=True)
    np.save(f"{folder}/BMUs.npy", nodes if columns is None else np.array([(n // columns, n % columns) if n >= 0 else (-1, -1) for n in nodes]))
    if config is not None:
        sinks.write_config(config, str(folder))


def of(records):
    return {r["run_id"].rsplit("/", 1)[1]: r for r in records.collect()}


def test_runs_in_folders_are_evaluated_once(spark, fields, tmp_path, monkeypatch):
    nodes = {"pairs": [k % 5 if k % 6 else -1 for k in range(24)], "flat": [k % 4 for k in range(24)], "short": [0, 1], "unsized": [0] * 24, "unfinished": [1] * 24}
    root, book = tmp_path / "runs", str(tmp_path / "ledger")
    save(root / "pairs", nodes["pairs"], 3, {"grid_size": [2, 3], "initialization": "pca", "seed": 7, "bmu_metric": "ssim"})
    save(root / "flat", np.array(nodes["flat"]), None, {"grid": [2, 2]})
    save(root / "short", nodes["short"], 2, {"grid": [2, 2]})
    save(root / "unsized", nodes["unsized"], 2, {"seed": 1})
    save(root / "unfinished", nodes["unfinished"], 2, None)
    asked = []
    whole = runs.indices_of_runs
    monkeypatch.setattr(runs, "indices_of_runs", lambda f, a, r: asked.append(r.count()) or whole(f, a, r))
    evaluate = lambda **kw: of(ledger.evaluate(fields, saved.in_folders(spark, str(root), str(tmp_path / "none")), book, "final", **kw))
    found = evaluate()
    assert sorted(found) == ["flat", "pairs", "short", "unsized"]
    assert found["short"]["note"] == "2 assignments for 24 fields." and found["unsized"]["note"].startswith("The size") and found["short"]["silhouette_euclidean"] is None
    assert (found["pairs"]["grid"], found["pairs"]["n_nodes_total"], found["pairs"]["seed"], found["pairs"]["initialization"], found["pairs"]["training_metric"]) == ("2x3", 6, 7, "pca", "ssim")
    placed = spark.createDataFrame([(r["t"] // 10, r["vec"]) for r in fields.collect()], "t long, vec array<double>")
    direct = spark.createDataFrame([(r, k, n) for r in ("pairs", "flat") for k, n in enumerate(nodes[r])], "run_id string, t long, node int")
    want = {r["run_id"]: r for r in whole(placed, direct, spark.createDataFrame([("pairs", 6), ("flat", 4)], "run_id string, n_nodes int")).collect()}
    for run in want:
        assert [found[run][c] for c in ("n_nodes_empty", "max_node_share", *runs.INDICES)] == pytest.approx([want[run][c] for c in ("n_nodes_empty", "max_node_share", *runs.INDICES)])
    assert evaluate() == found and asked == [2]
    save(root / "flat", np.array([k % 3 for k in range(24)]), None, {"grid": [2, 2]})
    os.utime(root / "flat" / "BMUs.npy", (1, 1))
    again = evaluate()
    assert asked == [2, 1] and again["flat"]["n_clusters_occupied"] == 3 and again["pairs"] == found["pairs"] and len(again) == 4
    assert ledger.read(spark, book).count() == 5
    fields.union(fields.withColumn("t", fields.t + 1000)).write.parquet(str(tmp_path / "more"))
    others = ledger.evaluate(spark.read.parquet(str(tmp_path / "more")), saved.in_folders(spark, str(root)), book, "final", group=2)
    assert {r["note"] for r in others.filter("training_metric = 'ssim' or grid = '2x2'").collect()} == {"24 assignments for 48 fields.", "2 assignments for 48 fields."}


def test_no_runs_and_names(spark, fields, tmp_path):
    assert ledger.evaluate(fields, saved.in_folders(spark, str(tmp_path / "none")), str(tmp_path / "book"), "final").count() == 0
    os.makedirs(tmp_path / "r" / "ssim_pca")
    for name in ("bmu_ssim_2x2_oct_mar_seed3", "weights"):
        np.save(tmp_path / "r" / "ssim_pca" / f"{name}.npy", np.array([(k % 2, k % 3 % 2) for k in range(24)]))
    listed = saved.by_name(spark, str(tmp_path / "r"), {"ssim_pca": ("ssim", "pca"), "gone": ("a", "b")})
    assert [(r["rows"], r["columns"], r["seed"], r["training_metric"], r["initialization"]) for r in listed.collect()] == [(2, 2, 3, "ssim", "pca")]
    found = ledger.evaluate(fields, listed, str(tmp_path / "book"), "exploratory").collect()
    assert [(r["grid"], r["phase"], r["n_clusters_occupied"], r["note"]) for r in found] == [("2x2", "exploratory", 4, "")]


def test_trained_runs_have_records(spark, sf_dir):
    found = comparison.trained_records(spark, sf_dir).collect()
    assert len({(r["training_metric"], r["initialization"], r["grid"]) for r in found}) == len(found) == 18
    assert all(r["n_clusters_occupied"] + r["n_nodes_empty"] == r["n_nodes_total"] for r in found) and all(r["note"] or -1 <= r["silhouette_euclidean"] <= 1 for r in found)


def test_a_fingerprint_tells_inputs_and_plans_apart(spark, fields, tmp_path):
    path = str(tmp_path / "fields")
    make = lambda k=2: spark.read.parquet(path).filter(f"t > {k}").selectExpr("t", "transform(vec, v -> v + 1) AS vec")
    first = sinks.fingerprint(make())
    assert first == sinks.fingerprint(make()) != sinks.fingerprint(make(3))
    kept = sinks.cached(make(), str(tmp_path / "cache"))
    stamp = sorted(os.listdir(tmp_path / "cache"))
    assert sinks.cached(make(), str(tmp_path / "cache")).count() == kept.count() == 23 and sorted(os.listdir(tmp_path / "cache")) == stamp
    part = next(f for f in os.listdir(path) if f.endswith(".parquet"))
    os.utime(f"{path}/{part}", (5, 5))
    assert sinks.fingerprint(make()) != first
    with pytest.raises(ValueError, match="does not tell"):
        sinks.fingerprint(spark.createDataFrame([(1,)], "a int"))
    with pytest.raises(ValueError, match="does not tell"):
        sinks.fingerprint(make().join(spark.createDataFrame([(1,)], "t long"), "t"))


@pytest.mark.parametrize("ranges", [1, 7, 300])
def test_ranks_do_not_depend_on_ranges(spark, monkeypatch, ranges):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 1, 2000) ** 3, np.repeat([0.5, -1e9, 1e300], 40), [np.inf, -np.inf]])
    monkeypatch.setattr(stats, "IN_RANGE", -(-2005 // ranges))
    order = np.sort(values)
    want = sorted(zip(values, (np.searchsorted(order, values, "left") + np.searchsorted(order, values, "right") + 1) / 2))
    found = stats.average_ranks(spark.createDataFrame([(float(v),) for v in values], "v double"))
    assert sorted((r["v"], r["rank"]) for r in found.collect()) == [(float(a), float(b)) for a, b in want]
    assert stats.average_ranks(spark.createDataFrame([], "v double")).count() == 0
