"""Comparisons of all with all: disk and rows stay in proportion to the vectors, results are those of plain matrices."""

from __future__ import annotations

import os

import numpy as np
import pytest

from fieldloom.operators import blocks, ledger, runs, som, validity
from fieldloom.sources import saved, sinks


def table(spark, x, parts=5):
    """Vectors in several parts, among them one without a value and one with a gap."""
    rows = [(10 * k, [float(v) for v in row]) for k, row in enumerate(x)] + [(-10, None), (-20, [None] * x.shape[1])]
    return spark.createDataFrame(rows, "t long, vec array<double>").repartition(parts)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def size(folder):
    return sum(os.path.getsize(f"{at}/{f}") for at, _, files in os.walk(folder) for f in files)


@pytest.mark.parametrize("n", [1, 2, 700])
def test_each_pair_once_without_a_shuffle(spark, n):
    x = np.random.default_rng(1).normal(3.0, 1.0, (n, 6))
    x[n // 2] = x[0]
    found = blocks.distances(table(spark, x), ("d_corr",))
    assert "Exchange" not in plan(found)
    rows = found.toArrow()
    i, j = rows["i"].to_numpy() // 10, rows["j"].to_numpy() // 10
    assert len(rows) == n * (n - 1) // 2 == len(set(zip(i.tolist(), j.tolist()))) and (i < j).all()
    assert np.allclose(rows["d_corr"].to_numpy(), (1 - np.corrcoef(x))[i, j] if n > 1 else [])


def test_vectors_are_stored_once(spark):
    x = np.random.default_rng(2).normal(size=(2000, 40))
    s = blocks.stored(table(spark, x).selectExpr("t", "array(int(t / 10) % 3, -1) AS node", "vec"))
    assert sum(s.rows) == 2000 and max(s.rows) <= blocks.BLOCK and s.cells == 40
    assert sorted(s.nodes) == [(0, 0, 667), (0, 1, 667), (0, 2, 666), (1, -1, 2000)]
    assert size(s.folder.removeprefix("file://")) < 1.2 * x.nbytes  # a copy for each other block before
    assert blocks.distances(table(spark, np.zeros((0, 3)))).count() == 0


def test_vectors_of_several_lengths_are_an_error(spark):
    uneven = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "t long, vec array<double>").repartition(2)
    with pytest.raises(Exception, match="several lengths|list_size|reshape"):
        blocks.distances(uneven)


def test_far_from_zero_copies_are_at_no_distance(spark):
    """Squares of large values left up to 7e-5 where there is nothing."""
    x = 300 + np.random.default_rng(3).normal(size=(300, 64))
    x[200:] = x[:100]
    found = blocks.distances(table(spark, x), ("d_euclid",))
    assert found.columns == ["i", "j", "d_euclid"] and "Exchange" not in plan(found)
    rows = found.toArrow()
    i, j = rows["i"].to_numpy() // 10, rows["j"].to_numpy() // 10
    assert len(rows) == 300 * 299 // 2
    assert np.abs(rows["d_euclid"].to_numpy() - np.sqrt(((x[i] - x[j]) ** 2).sum(axis=1))).max() < 5e-7


def means_by_node(d, nodes, own):
    """Silhouettes by their definition."""
    out = np.zeros(len(nodes))
    for k, n in enumerate(nodes):
        alone = (nodes == n).sum() == 1
        near = [d[k][nodes == m].mean() for m in own if m != n]
        if not alone and near:
            a, b = d[k][nodes == n].sum() / ((nodes == n).sum() - 1), min(near)
            out[k] = (b - a) / max(a, b)
    return out


@pytest.mark.parametrize("cells", [5, 300])  # squared distances from sums of vectors, and one by one
def test_scores_leave_a_task_complete(spark, cells):
    rng = np.random.default_rng(4)
    x = rng.normal(2.0, 1.0, (530, cells))
    nodes = np.stack([rng.integers(-1, 4, 530), np.zeros(530, int), np.where(np.arange(530) == 7, 900, rng.integers(0, 3, 530))])
    by_t = {10 * k: [int(n) for n in nodes[:, k]] for k in range(530)}
    own = spark.createDataFrame(list(by_t.items()), "t long, node array<int>")
    found = blocks.scores_by_run(table(spark, x).join(own, "t"))
    assert "Exchange" not in plan(found)
    rows = found.toPandas()
    fields = rows[rows["other"].isna()]
    assert len(fields) == (nodes >= 0).sum()  # a row for each node and pair of blocks before
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for run in range(3):
        there = np.flatnonzero(nodes[run] >= 0)
        own_nodes, kinds = nodes[run][there], np.unique(nodes[run][there])
        f = fields[fields["run"] == run].sort_values("t")
        near, c = d[np.ix_(there, there)], 1 - np.corrcoef(x[there])
        assert (f["t"] == 10 * there).all() and (f["node"] == own_nodes).all()
        assert np.allclose(f["se"], means_by_node(near, own_nodes, kinds)) and np.allclose(f["sc"], means_by_node(c, own_nodes, kinds))
        assert np.allclose(f["s"], (near**2).sum(axis=1)) and np.allclose(f["to_own"], [(near[k][own_nodes == n] ** 2).mean() for k, n in enumerate(own_nodes)])
        pairs = rows[~rows["other"].isna() & (rows["run"] == run)].groupby(["node", "other"])[["s", "n"]].sum()
        assert len(pairs) == len(kinds) ** 2
        for (a, b), r in pairs.iterrows():
            assert r["n"] == (own_nodes == a).sum() and np.isclose(r["s"], (near[np.ix_(own_nodes == a, own_nodes == b)] ** 2).sum())


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    store = spark._jsc.sc().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(found.apply(k).shuffleWriteBytes() for k in range(found.size()))


def test_trained_runs_shuffle_in_proportion_to_their_fields(spark, tmp_path):
    x = np.random.default_rng(10).normal(size=(1500, 8))
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "t long, vec array<double>").write.parquet(str(tmp_path / "x"))
    fields = spark.read.parquet(str(tmp_path / "x"))
    own = som.runs(spark, searches=("euclidean", "ssim"), starts=("pca",), seeds=(1,))
    named = som.train_runs(own, fields, 200).selectExpr("concat(search, '_', start, '/bmu_', size, 'x', size, '_seed', seed) AS run_id", "t", "CAST(floor(node / size) AS INT) AS node_i", "node % size AS node_j")
    sinks.write_npy(named, str(tmp_path / "runs"))
    before = shuffled(spark)
    listed = saved.by_name(spark, str(tmp_path / "runs"), {f"{s}_pca": (s, "pca") for s in ("euclidean", "ssim")})
    found = ledger.evaluate(fields, listed, str(tmp_path / "book"), "exploratory").collect()
    assert len(found) == 6 and all(r["n_clusters_occupied"] + r["n_nodes_empty"] == r["n_nodes_total"] for r in found)
    assert shuffled(spark) - before < 10 * x.nbytes


def test_runs_shuffle_in_proportion_to_their_fields(spark, tmp_path):
    """6 MB of shuffles for 4000 fields of 256 kB before, and more with their square."""
    x = np.random.default_rng(8).normal(size=(4000, 8))
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "t long, vec array<double>").write.parquet(str(tmp_path / "x"))
    fields = spark.read.parquet(str(tmp_path / "x"))
    assignments = fields.selectExpr("'a' AS run_id", "t", "CAST(t % 30 AS INT) AS node")
    own = spark.createDataFrame([("a", 6, "ssim", "6x6")], "run_id string, size int, training_metric string, grid string")
    before = shuffled(spark)
    row = validity.summary(runs.indices_of_runs(fields, assignments, own)).first()
    assert (row["n_runs"], row["nodes_occupied"], row["nodes_empty"]) == (1, 30.0, 6.0)
    assert shuffled(spark) - before < 4 * x.nbytes


def test_saved_runs_shuffle_in_proportion_to_their_fields(spark, tmp_path):
    x = np.random.default_rng(9).normal(size=(4000, 8))
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "t long, vec array<double>").write.parquet(str(tmp_path / "x"))
    os.makedirs(tmp_path / "runs" / "a")
    np.save(tmp_path / "runs" / "a" / "BMUs.npy", np.arange(4000) % 30)
    sinks.write_config({"grid_size": [6, 6]}, str(tmp_path / "runs" / "a"))
    before = shuffled(spark)
    row = ledger.evaluate(spark.read.parquet(str(tmp_path / "x")), saved.in_folders(spark, str(tmp_path / "runs")), str(tmp_path / "book"), "final").first()
    assert (row["n_clusters_occupied"], row["n_nodes_empty"], row["note"]) == (30, 6, "")
    assert shuffled(spark) - before < 6 * x.nbytes


def test_sums_of_distances_are_complete(spark):
    rng = np.random.default_rng(6)
    x, nodes = rng.normal(size=(600, 7)), rng.integers(-1, 5, 600)
    own = spark.createDataFrame([(10 * k, int(n)) for k, n in enumerate(nodes)], "t long, node int")
    for metric, d in (("euclidean", np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))), ("correlation", 1 - np.corrcoef(x))):
        found = blocks.distance_sums(table(spark, x).join(own, "t"), metric)
        assert "Exchange" not in plan(found)  # parts of sums from every pair of blocks before
        sums = {(r["t"], r["other"]): r["total"] for r in found.collect()}
        assert len(sums) == 600 * 6
        assert np.allclose([sums[10 * k, n] for k in range(600) for n in range(-1, 5)], [d[k][nodes == n].sum() for k in range(600) for n in range(-1, 5)])


def test_indices_shuffle_in_proportion_to_their_fields(spark, tmp_path):
    x = np.random.default_rng(11).normal(size=(6000, 8))
    spark.createDataFrame([(k, k % 10, v.tolist()) for k, v in enumerate(x)], "t long, node int, vec array<double>").write.parquet(str(tmp_path / "x"))
    before = shuffled(spark)
    row = validity.indices(spark.read.parquet(str(tmp_path / "x")), 16).first()
    assert (row["n_clusters_occupied"], row["n_nodes_empty"]) == (10, 6)
    assert shuffled(spark) - before < 10 * x.nbytes


def test_similarities_by_run_without_a_shuffle_of_vectors(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(1.0, 1.0, (600, 9))
    x[50] = 4.0
    nodes = np.stack([rng.integers(-1, 3, 600), np.arange(600)])
    own = spark.createDataFrame([(10 * k, [int(n) for n in nodes[:, k]]) for k in range(600)], "t long, node array<int>")
    found = blocks.pairwise_ssim_by_run(table(spark, x).join(own, "t"))
    assert "CoGroup" not in plan(found)  # blocks met by a shuffle of vectors before
    rows = {(r["run"], r["node"]): r for r in found.collect()}
    assert all(rows[1, k]["n_pairs"] == 0 for k in range(600))
    s = blocks.ssim_matrix(x, x)
    for n in range(3):
        k = np.flatnonzero(nodes[0] == n)
        part = s[np.ix_(k, k)][np.triu_indices(len(k), 1)]
        assert rows[0, n]["n_pairs"] == (~np.isnan(part)).sum() and np.isclose(rows[0, n]["ssim_sum"], np.nansum(part))
    assert len(rows) == 603


def test_coherence_by_size_shuffles_in_proportion(spark, tmp_path):
    x = np.random.default_rng(12).normal(1.0, 1.0, (12000, 8))
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "t long, vec array<double>").write.parquet(str(tmp_path / "x"))
    fields = spark.read.parquet(str(tmp_path / "x"))
    assignments = fields.selectExpr("'a' AS run_id", "t", "CAST(t % 5 AS INT) AS node")
    before = shuffled(spark)
    row = runs.coherence_by_size(runs.coherence_of_runs(fields, assignments), spark.createDataFrame([("a", 3)], "run_id string, size int")).first()
    assert (row["size"], row["n_runs"]) == (3, 1) and row["mean_ssim"] is not None
    assert shuffled(spark) - before < 4 * x.nbytes
