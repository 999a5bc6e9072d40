"""The normalisations against plain numpy over bins x cells matrices."""

import numpy as np
import pytest
from test_latent import plain_rounds

from cellcnv.functions.kernels import em
from cellcnv.functions.kernels.loess import Loess, positive
from cellcnv.functions.kernels.spline import SmoothingSpline
from cellcnv.operators import firstpass, latent, qc
from cellcnv.operators import em as em_operator


def planted(n=60, cells=9, seed=4):
    """Counts of cells with a GC curve and bin bias; cells 4 and on have three copies in the last third."""
    rng = np.random.default_rng(seed)
    gc = np.sort(rng.uniform(32, 58, n)).round(2)
    copies = np.full((n, cells), 2.0)
    copies[2 * n // 3 :, 4:] = 3
    mean = 80 * rng.uniform(0.7, 1.4, cells) * (1 + 0.015 * (gc - 45))[:, None] * rng.uniform(0.8, 1.2, n)[:, None] * copies / 2
    return rng.poisson(mean).astype(float), gc, np.arange(cells) < 4


def tables(spark, y, gc, normal):
    n, cells = y.shape
    depth = spark.createDataFrame([(f"c{j}", b + 1, int(y[b, j])) for b in range(n) for j in range(cells)], "cell string, bin_idx int, count long").repartition(3)
    bins = spark.createDataFrame([(b + 1, float(gc[b])) for b in range(n)], "bin_idx int, gc double")
    return depth, bins, spark.createDataFrame([(f"c{j}",) for j in np.flatnonzero(normal)], "cell string")


def library_sizes(y):
    full = (y > 0).all(axis=1)
    pseudo = np.exp(np.log(y[full]).mean(axis=1))
    factor = np.median(y[full] / pseudo[:, None], axis=0)
    return np.rint(factor / np.median(factor) * np.median(y.sum(axis=0)))


def bias(ratio):
    middle = np.median(ratio, axis=1)
    return np.where(middle > 0, middle, middle[middle > 0].min())


def three_digits(x):
    return np.array([float(f"{v:.3g}") for v in np.ravel(x)]).reshape(np.shape(x))


def test_first_pass_equals_numpy(spark):
    y, gc, normal = planted()
    lib, spline, beta = library_sizes(y), SmoothingSpline(gc), np.ones(len(gc))
    before, best, rounds = np.zeros_like(y), np.inf, 0
    for k in range(1, 11):
        f = np.stack([positive(spline.fit(y[:, j] / lib[j] / beta)) for j in range(y.shape[1])], axis=1)
        f = np.maximum(f, np.quantile(f, 0.005))
        new = bias((y / (f * lib))[:, normal])
        moved, change = np.mean((new - beta) ** 2), np.mean((f - before) ** 2)
        if change > best:
            break
        best, beta, before, kept, rounds = change, new, f, (f, new), k
        if moved < 1e-4 or k > 5 and moved > 1:
            break
    assert rounds > 1
    depth, bins, cells = tables(spark, y, gc, normal)
    assert [r["lib_size"] for r in qc.library_sizes(depth).orderBy("cell").collect()] == lib.tolist()
    found = firstpass.normalise_first(depth, bins, cells).toPandas()
    wide = lambda c: found.pivot(index="bin_idx", columns="cell", values=c).to_numpy()
    assert (wide("yhat") == np.maximum(np.rint(kept[0] * lib * kept[1][:, None]), 1)).all()
    assert np.allclose(wide("fgc"), three_digits(kept[0]), rtol=1e-9) and np.allclose(wide("beta")[:, 0], three_digits(kept[1]), rtol=1e-9)


def plain_normalise(y, gc, normal, ploidy, beta0, k, states, min_count):
    """Fitted expectation, curve and copy numbers with k factors, the scores, and the number of rounds."""
    n, cells = y.shape
    lib, smoother = library_sizes(y), Loess(gc)
    degrees, alpha0 = smoother.degrees(), np.zeros_like(y)
    ratio0 = y / (lib * beta0[:, None])
    for j in range(cells):
        alpha0[:, j] = ratio0[:, j] / (smoother.fit(ratio0[:, j]) / (ploidy[j] / 2)) * 2

    def curves(offset, alpha):
        f, a = np.zeros_like(y), np.full_like(y, 2.0)
        for j in range(cells):
            ratio = y[:, j] / offset[:, j]
            if normal[j]:
                f[:, j] = smoother.fit(ratio)
            else:
                best, a[:, j] = em.winner(em.fit_cell(y[:, j], ratio, offset[:, j], alpha[:, j], gc, smoother, degrees, states, min_count))
                f[:, j] = best["curve"]
        return f, a

    start = curves(lib * beta0[:, None], alpha0)
    again = start[1]
    beta, gh, before, best, rounds = beta0, np.zeros_like(y), np.zeros_like(y), np.inf, 0
    for r in range(1, 11):
        f, alpha = start if r == 1 else curves(lib * beta[:, None] * np.exp(gh), again)
        f = np.maximum(f, np.quantile(f, 0.005))
        new = bias((y / (f * lib * np.exp(gh)))[:, normal])
        moved, change = np.mean((new - beta) ** 2), np.mean((f - before) ** 2)
        if change > best:
            break
        best, beta, before, rounds = change, new, f, r
        g, h, _ = plain_rounds(y, np.log(lib * f * beta[:, None] * alpha / 2), np.flatnonzero(normal), k)
        gh = g @ h.T
        kept = f, alpha, beta, gh
        if moved < 1e-4 or r > 5 and moved > 1:
            break
    f, alpha, beta, gh = kept
    yhat = np.maximum(np.rint(f * lib * beta[:, None] * np.exp(gh)), 1)
    mean = yhat * alpha / 2
    loglik, p = (y * np.log(np.maximum(mean, 1)) - mean).sum(), k * (n + cells)
    return yhat, three_digits(f), alpha, (2 * loglik - 2 * p, 2 * loglik - p * np.log(n * cells), np.mean((y - mean) ** 2)), rounds


def test_normalisation_with_factors_equals_numpy(spark):
    y, gc, normal = planted()
    ploidy = np.where(normal, 2.0, 2.35)
    beta0 = bias((y / library_sizes(y))[:, normal]) * len(gc)
    depth, bins, _ = tables(spark, y, gc, normal)
    cells = spark.createDataFrame([(f"c{j}", bool(normal[j]), float(ploidy[j])) for j in range(y.shape[1])], "cell string, is_normal boolean, ploidy double")
    out = latent.normalise(depth, bins, cells, beta0, [1, 2], [1, 2, 3, 4], min_count=5)
    fit, scores = out["fit"].toPandas(), {r["k"]: r for r in out["scores"].collect()}
    wants = {k: plain_normalise(y, gc, normal, ploidy, beta0, k, [1, 2, 3, 4], 5) for k in (1, 2)}
    for k, (yhat, fgc, alpha, want, rounds) in wants.items():
        wide = lambda c: fit[fit["k"] == k].pivot(index="bin_idx", columns="cell", values=c).to_numpy()  # noqa: B023, E731
        assert np.allclose(wide("fgc"), fgc, rtol=1e-6) and (wide("alpha") == alpha).all() and np.abs(wide("yhat") - yhat).max() <= 1
        assert [scores[k][c] for c in ("aic", "bic", "rss")] == pytest.approx(want, rel=1e-4) and rounds >= 1
    best = latent.best_fit(out).select("k").distinct().collect()
    assert [r["k"] for r in best] == [max(wants, key=lambda k: (wants[k][3][1], -k))]


def test_curve_points_follow_their_definition(spark):
    y, gc, _ = planted(40, 2)
    ratio = y / y.mean()
    cells = spark.createDataFrame([(f"c{j}", False, 2.2, y[:, j].tolist(), ratio[:, j].tolist(), [float(y.mean())] * 40) for j in range(2)], "cell string, is_normal boolean, ploidy double, count array<double>, ratio array<double>, offset array<double>")
    ready = em_operator.initial_alpha(cells, gc)
    found = em_operator.diagnostics(ready, gc, [1, 3], 5)
    bins = spark.createDataFrame([(b + 1, float(gc[b])) for b in range(40)], "bin_idx int, gc double")
    points = em_operator.curve_points(found, cells, bins).toPandas().sort_values(["cell", "t", "bin_idx"])
    assert len(points) == 2 * 2 * 40
    smoother = Loess(gc)
    for j in range(2):
        alpha = ratio[:, j] / (smoother.fit(ratio[:, j]) / 1.1) * 2
        for fit in em.fit_cell(y[:, j], ratio[:, j], np.full(40, y.mean()), alpha, gc, smoother, smoother.degrees(), [1, 3], 5):
            own = points[(points["cell"] == f"c{j}") & (points["t"] == fit["t"])]
            state = fit["z"].argmax(axis=1) + 1
            assert (own["state"] == state).all() and np.allclose(own["ratio"], ratio[:, j]) and np.allclose(own["gc"], gc)
            assert np.allclose(own["fitted"], fit["curve"] * state / 2)


def test_quality_control_wants_equal_cells_and_bins(spark):
    depth = spark.createDataFrame([("a", 1, 5), ("b", 1, 5)], "cell string, bin_idx int, count long")
    bins = spark.createDataFrame([(1,)], "bin_idx int")
    metrics = spark.createDataFrame([("a",), ("b",)], "cell string")
    qc.check_inputs(depth, bins, metrics)
    more = spark.createDataFrame([(1,), (2,)], "bin_idx int")
    for wrong in ((depth, more, metrics), (depth, bins.where("bin_idx > 1"), metrics), (depth, bins, metrics.where("cell = 'a'")), (depth.where("cell = 'a'"), bins, metrics)):
        with pytest.raises(ValueError, match="don't hold the same"):
            qc.check_inputs(*wrong)
