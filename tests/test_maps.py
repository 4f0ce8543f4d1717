from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import blocks, bmu, nodes, sliding, som, stats, validity

FIELDS = "t long, node int, vec array<double>"


def frame(spark, data, labels=None):
    labels = [0] * len(data) if labels is None else labels
    return spark.createDataFrame([(t, int(k), [float(v) for v in x]) for t, (k, x) in enumerate(zip(labels, data, strict=True))], FIELDS)


def test_metrics_of_identical_constant_and_opposite_vectors(spark):
    x = [0.1, 0.4, 0.9, 0.2]
    w = spark.createDataFrame([(0, x), (1, [0.5] * 4), (2, [1 - v for v in x])], "node int, vec array<double>")
    d = lambda name: {r["node"]: r["d"] for r in bmu.distances_to(frame(spark, [x]).drop("node"), w, name).collect()}
    assert d("ssim")[0] == pytest.approx(-1.0)
    assert d("correlation") == {0: pytest.approx(0, abs=1e-12), 1: 1.0, 2: pytest.approx(2.0)}
    assert d("euclidean")[0] == pytest.approx(0, abs=1e-7)


def test_ties_go_to_the_first_node_and_gaps_stay_unassigned(spark):
    w = spark.createDataFrame([(2, [0.0, 1.0]), (1, [1.0, 0.0]), (5, [9.0, 9.0])], "node int, vec array<double>")
    x = spark.createDataFrame([(0, [0.5, 0.5]), (1, [None, 0.5])], "t long, vec array<double>")
    assert {r["t"]: r["node"] for r in bmu.assign(x, w, "euclidean").collect()} == {0: 1, 1: -1}


def test_assignment_does_not_depend_on_row_order(spark):
    rng = np.random.default_rng(0)
    data, protos = rng.random((40, 6)), rng.random((4, 6))
    w = spark.createDataFrame([(k, [float(v) for v in p]) for k, p in enumerate(protos)], "node int, vec array<double>")
    for name in ("euclidean", "correlation", "ssim"):
        want = {t: int(np.argmin(som.distances(x, protos, name))) for t, x in enumerate(data)}
        for df in (frame(spark, data), frame(spark, data).orderBy(F.desc("t"))):
            assert {r["t"]: r["node"] for r in bmu.assign(df, w, name).collect()} == want


def numpy_silhouette(d, labels):
    out = []
    for i, k in enumerate(labels):
        own = (labels == k) & (np.arange(len(labels)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a = d[i][own].mean()
        b = min(d[i][labels == j].mean() for j in set(labels) - {k})
        out.append((b - a) / max(a, b))
    return np.mean(out)


@pytest.mark.parametrize("block", [4, 512])
def test_indices_against_numpy(spark, block, monkeypatch):
    monkeypatch.setattr(blocks.block_pairs, "__defaults__", (block, None))
    rng = np.random.default_rng(1)
    data, labels = rng.random((23, 5)), np.array([0] * 9 + [1] * 8 + [3] * 5 + [7])
    df = frame(spark, data, labels)
    r = validity.indices(df, 9).first()
    e, cor = blocks.euclidean_matrix(data, data), blocks.correlation_matrix(data, data)
    assert r["silhouette_euclidean"] == pytest.approx(numpy_silhouette(e, labels))
    assert r["silhouette_correlation"] == pytest.approx(numpy_silhouette(cor, labels))
    assert (r["n_nodes_empty"], r["n_clusters_occupied"]) == (5, 4)
    moved = validity.indices(frame(spark, data, (labels * 3 + 2) % 11), 11).first()
    for c in ("silhouette_euclidean", "silhouette_correlation", "davies_bouldin", "calinski_harabasz"):
        assert moved[c] == pytest.approx(r[c])


def test_degenerate_partitions(spark):
    one = validity.indices(frame(spark, np.eye(3), [4, 4, 4]), 9).first()
    assert one["silhouette_euclidean"] is None and one["davies_bouldin"] is None and one["calinski_harabasz"] is None
    assert one["note"] == validity.NOTE and one["occupancy_entropy"] == pytest.approx(0)
    each = validity.indices(frame(spark, np.eye(3), [0, 1, 2]), 3).first()
    assert each["silhouette_euclidean"] is None and each["calinski_harabasz"] is None
    assert each["occupancy_entropy"] == pytest.approx(1)


def test_kernel_is_normalised_odd_and_mirrored():
    k = sliding.gaussian(11, 1.5)
    assert k.sum() == pytest.approx(1) and k.argmax() == 5
    with pytest.raises(ValueError, match="odd"):
        sliding.gaussian(10, 1.5)
    assert sliding.band(8, sliding.gaussian(5, 1.0)).sum(axis=1) == pytest.approx(np.ones(8))


def direct_ssim(a, b, mask, size, sigma):
    """Without matrices: every window cell by cell."""
    half = size // 2
    k = np.outer(sliding.gaussian(size, sigma), sliding.gaussian(size, sigma))
    fold = lambda i, n: i % (2 * n) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n)
    h, w = a.shape
    out = []
    for y in range(h):
        for x in range(w):
            ys, xs = [fold(y + d, h) for d in range(-half, half + 1)], [fold(x + d, w) for d in range(-half, half + 1)]
            m = k * mask[np.ix_(ys, xs)]
            total = m.sum() or 1.0
            mean = lambda v, m=m, ys=ys, xs=xs, total=total: (m * np.where(mask, v, 0)[np.ix_(ys, xs)]).sum() / total
            ma, mb = mean(a), mean(b)
            va, vb, cov = mean(a * a) - ma * ma, mean(b * b) - mb * mb, mean(a * b) - ma * mb
            out.append((2 * ma * mb + 1e-4) * (2 * cov + 9e-4) / ((ma * ma + mb * mb + 1e-4) * (va + vb + 9e-4) + 1e-12))
    return np.mean(out)


def test_sliding_similarity_against_direct_windows():
    rng = np.random.default_rng(2)
    a, b, mask = rng.random((9, 7)), rng.random((9, 7)), rng.random((9, 7)) > 0.2
    window = sliding.Window(mask, 5, 1.5)
    assert float(window.similarity(a, b)) == pytest.approx(direct_ssim(a, b, mask, 5, 1.5))
    assert float(window.similarity(a, a)) == pytest.approx(1, abs=1e-6)


def test_windows_without_valid_cells_count_as_nearly_one():
    mask = np.ones((20, 20), bool)
    mask[8:, 8:] = False
    a, b = np.zeros((20, 20)), np.ones((20, 20))
    window = sliding.Window(mask, 5, 1.5)
    far = window.ssim(*(window.mean(v)[15:16, 15:16] for v in (a, b, a * a, b * b, a * b)))
    assert float(far) == pytest.approx(0.999989, abs=1e-5)
    assert float(sliding.Window(mask, 5, 1.5, valid_only=True).similarity(a, b)) < float(window.similarity(a, b))


def test_moving_prototypes_keep_their_window_means():
    rng = np.random.default_rng(3)
    mask = rng.random((6, 6)) > 0.1
    window = sliding.Window(mask, 3, 1.0)
    stack, x = sliding.Stack(window, rng.random((4, 6, 6))), np.where(mask, rng.random((6, 6)), 0)
    m, s = window.mean(x), window.mean(x * x)
    _, product = stack.distances(x, m, s)
    stack.move(x, m, s, product, np.array([0.1, 0.5, 0.9, 0.0]))
    again = sliding.Stack(window, stack.images)
    assert stack.m == pytest.approx(again.m) and stack.s == pytest.approx(again.s)


def test_random_start_outside_the_data_collapses_to_one_node():
    data = np.random.default_rng(4).random((50, 30))
    w = som.exploratory_train(data, 4, "euclidean", "random", 999, iterations=800)
    assert len(set(som.winners(data, w, "euclidean"))) == 1


def test_exploratory_draws_in_the_documented_order():
    data = np.random.default_rng(5).random((12, 8))
    w = som.exploratory_train(data, 3, "ssim", "random", 7, iterations=1)
    random = np.random.RandomState(7)
    start = data[random.choice(12, 9, replace=True)]
    x = data[random.randint(0, 12)]
    best = int(np.argmin(som.distances(x, start, "ssim")))
    assert w[best] == pytest.approx(start[best] + 0.5 * (x - start[best]))


def test_runs_are_all_combinations(spark):
    runs = som.runs(spark)
    assert runs.count() == 216 == runs.select("run_id").distinct().count()


def test_final_training_ignores_the_seed_with_pca(spark):
    data = np.random.default_rng(6).random((20, 16))
    mask = np.ones((4, 4), bool)
    one = som.final_train(data, som.FinalConfig(grid=2, epochs=2, window=3, seed=1), mask)
    two = som.final_train(data, som.FinalConfig(grid=2, epochs=2, window=3, seed=2), mask)
    assert one[0] == pytest.approx(two[0]) and (one[1] == two[1]).all()
    data[3, 5] = np.nan
    assert som.final_train(data, som.FinalConfig(grid=2, epochs=1, window=3), mask)[1][3] == -1


def test_wrong_parameters_are_named_together():
    with pytest.raises(ValueError, match="grid.*lr.*window"):
        som.FinalConfig(grid=1, lr=2, window=4).checked()


def test_counts_are_dense_and_skip_unassigned(spark):
    b = spark.createDataFrame([(0, 2000, 11, 0, 0), (1, 2000, 12, -1, -1), (2, 2001, 1, 1, 1)], "t int, year int, month int, node_i int, node_j int")
    counts = nodes.dense_counts(b, 2, 2).collect()
    assert len(counts) == 4 and sum(r["n"] for r in counts) == 2
    assert nodes.node_month_dense(b, 2, 2).count() == 24
    assert [(r["season_year"], r["mean_index"]) for r in nodes.seasonal_index(b).collect()] == [(2000, -0.5)]
    phases = spark.createDataFrame([(1999, "La Niña")], "season_year int, phase string")
    assert nodes.seasonal_index(b, phases).count() == 0
    assert nodes.season_phase(nodes.seasonal_index(b), phases).first()["phase"] == "Neutral"


def test_statistics_against_known_values(spark):
    rows = [(g, float(v)) for g, vs in (("a", (6, 8, 4, 5, 3, 4)), ("b", (8, 12, 9, 11, 6, 8)), ("c", (13, 9, 11, 8, 7, 12))) for v in vs]
    r = stats.anova(spark.createDataFrame(rows, "g string, v double"), "g", "v").first()
    assert (r["df1"], r["df2"]) == (2, 15) and r["statistic"] == pytest.approx(9.3, abs=0.05)
    assert stats.upper_f(spark, r["statistic"], 2, 15) == pytest.approx(0.0024, abs=2e-4)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert stats.pearson(flat, "x", "y").first()["r"] is None
    ranks = stats.average_ranks(spark.createDataFrame([(3.0,), (1.0,), (3.0,), (2.0,)], "v double"))
    assert sorted((r["v"], r["rank"]) for r in ranks.collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]


def test_shapiro_of_a_published_sample():
    # eleven men's weights in pounds, Shapiro & Wilk (1965)
    w, p = stats.shapiro([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.01) and p == pytest.approx(0.0067, abs=0.001)
    assert stats.shapiro([1.0, 1.0, 1.0]) == (1.0, 1.0)
    with pytest.raises(ValueError, match="3 to"):
        stats.shapiro([1.0])
