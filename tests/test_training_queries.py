"""The training queries run the whole training, not a part of it."""

from __future__ import annotations

from fieldloom.operators import som
from fieldloom.plans import catalog, classification


def test_multiseed_runs_trains_5000_steps(spark, sf_dir, monkeypatch):
    few = som.runs(spark, ("ssim",), ("random",), (4,), (1, 10))
    monkeypatch.setattr(som, "runs", lambda spark: few)
    found = {(r["run_id"], r["t"]): r["node"] for r in classification.multiseed_runs(spark, sf_dir).collect()}
    times, data = som.matrix_of(classification._scaled(catalog.fields(spark, sf_dir)))
    want = lambda n: {(r["run_id"], t): k for r in few.collect() for t, k in zip(times, som.winners(data, som.exploratory_train(data, 4, "ssim", "random", r["seed"], n), "ssim"), strict=True)}
    assert found == want(5000) != want(500)


def test_som_epoch_fold_trains_8_epochs_with_window_11(spark, sf_dir):
    import numpy as np

    found = classification.som_epoch_fold(spark, sf_dir).collect()
    assert {r["run_id"] for r in found} == {"ssim_full_4x4_pca_ep8_lr0.4_seed145"}
    times, data = som.matrix_of(classification._scaled(catalog.fields(spark, sf_dir)))
    _, nodes = som.final_train(data, som.FinalConfig(epochs=8, window=11), np.ones((8, 8), bool))
    assert {r["t"]: r["node"] for r in found} == dict(zip(times, nodes, strict=True))
