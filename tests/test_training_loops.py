"""Both trainings against loops written out node by node."""

from __future__ import annotations

import math

import numpy as np
import pytest

from fieldloom.operators import som


def gap(x, w, search):
    if search == "euclidean":
        return math.sqrt(sum((a - b) ** 2 for a, b in zip(x, w)))
    mx, mw = sum(x) / len(x), sum(w) / len(w)
    vx, vw = (sum((a - m) ** 2 for a in v) / len(v) for v, m in ((x, mx), (w, mw)))
    cov = sum((a - mx) * (b - mw) for a, b in zip(x, w)) / len(x)
    if search == "correlation":
        return 1 - cov / math.sqrt(vx * vw)
    return -((2 * mx * mw + 1e-4) * (2 * cov + 9e-4)) / ((mx**2 + mw**2 + 1e-4) * (vx + vw + 9e-4))


@pytest.mark.parametrize("search", som.SEARCHES)
def test_exploratory_training(search):
    data = np.random.default_rng(1).random((20, 6))
    size, steps, seed = 3, 400, 10
    random = np.random.RandomState(seed)
    if search == "ssim":
        w = data[random.choice(20, size * size, replace=True)].reshape(size, size, -1).copy()
    else:
        w = random.rand(size, size, 6) * 2 - 1
    for t in range(steps):
        x = data[random.randint(0, 20)]
        rate, radius = 0.5 * math.exp(-t / steps), 1.0 * math.exp(-t / steps)
        _, bi, bj = min((gap(x, w[i, j], search), i, j) for i in range(size) for j in range(size))
        for i in range(size):
            for j in range(size):
                d2 = (i - bi) ** 2 + (j - bj) ** 2
                if d2 <= radius**2:
                    w[i, j] += rate * math.exp(-d2 / (2 * radius**2)) * (x - w[i, j])
    found = som.exploratory_train(data, size, search, "random", seed, steps)
    assert found == pytest.approx(w.reshape(size * size, -1))


def sliding(a, b, mask, size, sigma):
    """The similarity of two images cell by cell, with mirrored borders."""
    ny, nx = mask.shape
    half = size // 2
    taps = [(u, v, math.exp(-(u * u + v * v) / (2 * sigma**2))) for u in range(-half, half + 1) for v in range(-half, half + 1)]
    norm = sum(g for _, _, g in taps)
    fold = lambda k, n: -1 - k if k < 0 else 2 * n - 1 - k if k >= n else k
    scores = []
    for y in range(ny):
        for x in range(nx):
            cells = [(fold(y + u, ny), fold(x + v, nx), g / norm) for u, v, g in taps]
            weight = sum(g for i, j, g in cells if mask[i, j]) or 1.0
            mean = lambda f: sum(g * f(i, j) for i, j, g in cells if mask[i, j]) / weight  # noqa: B023, E731
            ma, mb = mean(lambda i, j: a[i, j]), mean(lambda i, j: b[i, j])
            va, vb, c = mean(lambda i, j: a[i, j] ** 2) - ma**2, mean(lambda i, j: b[i, j] ** 2) - mb**2, mean(lambda i, j: a[i, j] * b[i, j]) - ma * mb
            scores.append((2 * ma * mb + 1e-4) * (2 * c + 9e-4) / ((ma**2 + mb**2 + 1e-4) * (va + vb + 9e-4) + 1e-12))
    return sum(scores) / len(scores)


def test_final_training():
    mask = np.ones((6, 5), bool)
    mask[0, 0] = mask[3, 2] = False
    data = np.random.default_rng(2).random((7, int(mask.sum())))
    data[4, 1] = np.nan
    config = som.FinalConfig(grid=2, init="random", epochs=2, window=5, seed=3)
    w = np.random.default_rng(3).random((2, 2, data.shape[1]), dtype=np.float32).reshape(4, -1).astype(float)

    def image(v):
        out = np.zeros(mask.shape)
        out[mask] = v
        return out

    def best(x):
        return min((1 - sliding(image(x), image(v), mask, 5, 1.5), k) for k, v in enumerate(w))[1]

    for epoch in range(2):
        fade = 1 - epoch / 2
        for x in data:
            if np.isnan(x).any():
                continue
            k = best(x)
            for n in range(4):
                d2 = (n // 2 - k // 2) ** 2 + (n % 2 - k % 2) ** 2
                w[n] += 0.4 * fade * math.exp(-d2 / (2 * (1.0 * fade) ** 2)) * (x - w[n])
    found, nodes = som.final_train(data, config, mask)
    assert found == pytest.approx(w)
    assert nodes.tolist() == [-1 if np.isnan(x).any() else best(x) for x in data]


def test_doubtful_parameters_are_allowed_with_a_warning():
    with pytest.warns(UserWarning, match="12 x 12"):
        assert som.FinalConfig(grid=12).checked().grid == 12
    with pytest.warns(UserWarning, match="window of 23"):
        som.FinalConfig(window=23).checked()
    with pytest.raises(ValueError, match="odd"):
        som.FinalConfig(window=24).checked()
