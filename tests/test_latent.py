"""Latent factors against plain numpy: first vectors, the rounds of g and h, clamping, the choice of K."""

import numpy as np
import pytest

from cellcnv.functions.kernels import poisson
from cellcnv.operators import latent


def planted(bins=90, cells=24, k=2, seed=1):
    """Counts with k latent factors, and the log expectation without them."""
    rng = np.random.default_rng(seed)
    g, h = rng.normal(0, 0.3, (bins, k)), np.linalg.qr(rng.normal(size=(cells, k)))[0]
    base = rng.normal(4, 0.2, (bins, cells))
    return rng.poisson(np.exp(base + 3 * g @ h.T)).astype(float), base


def packed(spark, y, base):
    bins, cells = y.shape
    by_bin = spark.createDataFrame([(b + 1, y[b].tolist(), base[b].tolist()) for b in range(bins)], "bin_idx int, count array<double>, base array<double>").repartition(3)
    by_cell = spark.createDataFrame([(f"c{c:03d}", y[:, c].tolist(), base[:, c].tolist()) for c in range(cells)], "cell string, count array<double>, base array<double>").repartition(3)
    return by_bin, by_cell


def rest_of(y, base):
    rest = np.log(np.maximum(y, 1)) - base
    return rest - rest.mean(axis=1, keepdims=True)


@pytest.mark.parametrize(("bins", "cells", "k"), [(90, 24, 2), (400, 150, 3), (30, 5, 1), (12, 40, 4)])
def test_first_vectors_span_those_of_a_whole_decomposition(spark, bins, cells, k):
    y, base = planted(bins, cells, k, seed=cells)
    found = latent.first_factors(packed(spark, y, base)[0], k)
    want = np.linalg.svd(rest_of(y, base), full_matrices=False)[2][:k].T
    assert found.shape == (cells, k) and np.abs(found @ found.T - want @ want.T).max() < 1e-8
    assert np.allclose(found, latent.signed(want), atol=1e-6)


def plain_rounds(y, base, normal, k):
    h, changes = latent.signed(np.linalg.svd(rest_of(y, base), full_matrices=False)[2][:k].T), []
    while True:
        g = np.zeros((len(y), k))
        for b in range(len(y)):
            one, ok = poisson.regress(y[b : b + 1, normal], h[normal], base[b : b + 1, normal])
            g[b] = one[0] if ok[0] else poisson.least_squares(y[b : b + 1, normal], h[normal], base[b : b + 1, normal])[0]
        if g.max() >= 30:
            g = np.where(g > np.quantile(g, 0.995, axis=0), np.minimum(np.quantile(g, 0.995, axis=0), 30), g)
        if g.min() <= -30:
            g = np.where(g < np.quantile(g, 0.005, axis=0), np.maximum(np.quantile(g, 0.005, axis=0), -30), g)
        fitted = np.stack([poisson.regress(y[:, [c]].T, g, base[:, [c]].T)[0][0] for c in range(y.shape[1])])
        product = g @ fitted.T
        new = latent.signed(np.linalg.svd(product - product.mean(axis=0), full_matrices=False)[2][:k].T)
        changes.append(np.mean((new - h) ** 2))
        h = new
        if changes[-1] < 1e-5 or len(changes) == 50 or (len(changes) > 10 and np.argsort(np.argsort(changes))[-1] < 3):
            return g, h, len(changes)


@pytest.mark.parametrize("tasks", [1, 3])
def test_rounds_in_one_stage_equal_plain_rounds(spark, tasks):
    y, base = planted()
    normal = np.arange(0, 24, 2)
    g, h = latent.factor_rounds(*packed(spark, y, base), normal, 2, tasks)
    want_g, want_h, rounds = plain_rounds(y, base, normal, 2)
    assert rounds > 1 and np.abs(g @ h.T - want_g @ want_h.T).max() < 1e-8


def test_extreme_factors_are_drawn_in():
    g = np.linspace(-1, 1, 1000)[:, None] * [1, 1]
    assert (latent.limited(g) == g).all()
    g[[3, 500], 0], g[7, 1] = [80, 60], -90
    found = latent.limited(g)
    high, low = np.quantile(g, 0.995, axis=0), np.quantile(g, 0.005, axis=0)
    assert found[3, 0] == min(high[0], 30) and found[7, 1] == max(low[1], -30) and found[100, 0] == g[100, 0]


def test_largest_score_chooses_k(spark):
    scores = spark.createDataFrame([(1, -5.0), (2, -3.0), (3, -3.0)], "k int, bic double")
    assert latent.best_k(scores).first()["k"] == 2
