"""Choice of windows, nested search and model score against plain versions."""

import math

import numpy as np
import pytest

from cellcnv.functions.kernels import segments as kernel
from cellcnv.operators import segment

WINDOWS = "chrom string, seg long, i long, j long, z double"


def greedy(windows):
    """Windows by falling statistic without what overlaps one taken before."""
    out = []
    for z, i, j in sorted((-z, i, j) for i, j, z in windows):
        if all(j < a or i > b for a, b, _ in out):
            out.append((i, j, -z))
    return out


@pytest.mark.parametrize("kinds", [3, 1000])
def test_choice_in_rounds_equals_the_greedy_choice(spark, kinds):
    rng = np.random.default_rng(kinds)
    rows = []
    for chrom, n, seg in (("a", 30, 1), ("b", 45, 1), ("b", 12, 50), ("c", 3, 1)):
        for i in range(seg, seg + n):
            rows += [(chrom, seg, i, j, float(rng.integers(1, kinds))) for j in range(i + 1, seg + n) if rng.random() < 0.6]
    found = segment.non_overlapping(spark.createDataFrame(rows, WINDOWS)).collect()
    for chrom, seg in {r[:2] for r in rows}:
        want = greedy([r[2:] for r in rows if r[:2] == (chrom, seg)])
        assert sorted((r["i"], r["j"], r["z"]) for r in found if (r["chrom"], r["seg"]) == (chrom, seg)) == sorted(want)
    assert segment.non_overlapping(spark.createDataFrame([], WINDOWS)).count() == 0


def scanned(y, lam, a, b):
    """Windows (i, j, z), from 1, inside bins a..b: straight from the definition."""
    y, lam = y[:, a - 1 : b].copy(), lam[:, a - 1 : b].copy()
    for c in range(len(y)):
        low = lam[c] < 10
        if (low & (y[c] < 10)).any():
            y[c][low] = 10
        lam[c][low] = 10
    n, out = b - a + 1, []
    sums = [np.hstack([np.zeros((len(v), 1)), v.cumsum(axis=1)]) for v in (y, lam)]

    def part(p, q):
        s, t = (v[:, q] - v[:, p] for v in sums)
        with np.errstate(invalid="ignore", divide="ignore"):
            copies = np.where(t > 0, np.rint(2 * s / t), 2.0)
        return ((1 - copies / 2) * t + np.log((copies + 1e-4) / 2.0001) * s).sum()

    for i in range(n):
        out += [(a + i, a + j, part(0, i) + part(i, j + 1) + part(j + 1, n)) for j in range(i + 1, n)]
    return out


def searched(y, lam, a, b):
    """Segments of one range and whether they are nested."""
    windows = [w for w in scanned(y, lam, a, b) if w[2] > 0]
    taken = [[i, j, round(z, 3)] for i, j, z in greedy(windows) if j - i > 1 and z > 10]
    at = {(i, j) for i, j, _ in windows}
    low, high = (min(w[0] for w in taken), max(w[1] for w in taken)) if taken else (a, b)
    return kernel.repaired(taken, a, b, (a, low - 1) in at, (high + 1, b) in at)


@pytest.mark.parametrize(("n", "cells"), [(40, 5), (120, 3)])
def test_nested_search_equals_a_plain_one(spark, n, cells):
    rng = np.random.default_rng(n)
    level = np.full(n, 2.0)
    level[n // 8 : n - n // 8] = 3
    level[n // 4 : n // 2] = 4
    level[n // 3 : n // 3 + 4] = 2
    lam = rng.uniform(5, 60, (cells, n))
    y = rng.poisson(lam * np.where(np.arange(cells)[:, None] % 2, level / 2, 1)).astype(float)
    rows = [("chr1", f"c{c}", p + 1, float(y[c, p]), float(lam[c, p])) for c in range(cells) for p in range(n)]
    packed = segment.packed_cells(spark.createDataFrame(rows, "chrom string, cell string, pos int, count double, yhat double"))
    first, _ = searched(y, lam, 1, n)
    want, split = list(first), 0
    for _ in range(2):
        again = [(s, *searched(y, lam, *s)) for s in want]
        if not any(nested for *_, nested in again):
            break
        split += 1
        want = [p for s, parts, nested in again for p in (parts if nested else [s])]
    ranges = spark.createDataFrame([("chr1", 1, n)], "chrom string, st long, ed long")
    found = segment.picked_segments(segment.scan_packed(packed, ranges, 2, 25), ranges)
    assert sorted((r["st"], r["ed"]) for r in found.collect()) == sorted(first)
    found = segment.nested_search(packed, spark.createDataFrame([("chr1", *s) for s in first], "chrom string, st long, ed long"), 2)
    assert sorted((r["st"], r["ed"]) for r in found.collect()) == sorted(want)


def test_scan_of_many_bins_equals_the_definition(spark):
    rng = np.random.default_rng(9)
    lam = rng.uniform(8, 40, (2, 500))
    y = rng.poisson(lam).astype(float)
    rows = [("chr1", f"c{c}", y[c].tolist(), lam[c].tolist()) for c in range(2)]
    packed = spark.createDataFrame(rows, "chrom string, cell string, y array<double>, lambda array<double>")
    ranges = spark.createDataFrame([("chr1", 1, 500)], "chrom string, st long, ed long")
    found = segment.scan_packed(packed, ranges, cells_per_task=1, bins_per_task=150).toPandas().set_index(["i", "j"])["z"]
    want = scanned(y, lam, 1, 500)
    assert len(found) == len(want) == 500 * 499 // 2
    assert np.allclose(found.loc[[w[:2] for w in want]].to_numpy(), [w[2] for w in want], atol=1e-7)


def plain_score(y, yhat, ranked):
    """The modified BIC of some segments among cells x bins; the gaps between them count for the likelihood only."""
    cells, n = y.shape
    borders = sorted({1, n, *(x for p in ranked for x in p)})
    pairs = kernel.tile(ranked, 1, n)
    inner = len(borders) - 2
    if inner <= 0:
        return 0.0
    loglik, jumps, carriers = 0.0, np.zeros(inner), 0
    for c in range(cells):
        high = [np.maximum(v[c], 20) for v in (y, yhat)]
        means = [np.rint(high[0][: borders[1]].mean())]
        ratios = [np.rint(2 * high[0][: borders[1]].sum() / high[1][: borders[1]].sum())]
        for a, b in zip(borders[1:], borders[2:]):
            means.append(np.rint(high[1][a:b].sum() / (b - a + 1)))
            ratios.append(np.rint(high[0][a:b].sum() / high[1][a:b].sum()))
        for a, b in pairs:
            s, t = y[c, a - 1 : b].sum(), yhat[c, a - 1 : b].sum()
            s, t = (20.0, 20.0) if t < 20 else (s, t)
            copies = np.rint(2 * s / t)
            loglik += (1 - copies / 2) * t + np.log((copies + 1e-4) / 2.0001) * s
        moved = np.diff(ratios) != 0
        carriers += moved.sum()
        jumps += (np.diff(means) * (np.ones(1) if inner == 1 else moved)) ** 2
    total, share = cells * inner, carriers / (cells * inner)
    ways = math.log(math.comb(n, inner))
    entropy = 0 if share in (0, 1) else -total * (share * math.log(share) + (1 - share) * math.log(1 - share))
    cost = carriers / 2 * (math.log(2 * loglik / carriers) + 1) if carriers else 0
    return loglik - cost - ways - math.log(max(jumps.max(), 1)) - inner * (1.5 - 2.27) - entropy


def test_model_score_equals_its_formula(spark):
    rng = np.random.default_rng(11)
    n, cells = 30, 4
    yhat = rng.uniform(30, 90, (cells, n))
    level = np.where(np.arange(cells)[:, None] > 1, np.repeat([2, 4, 1], 10), 2)
    y = rng.poisson(yhat * level / 2).astype(float)
    rows = [("chr1", f"c{c}", p + 1, float(y[c, p]), float(yhat[c, p])) for c in range(cells) for p in range(n)]
    fit = spark.createDataFrame(rows, "chrom string, cell string, pos int, count double, yhat double")
    ranked = [(11, 20), (21, 30), (1, 10)]
    table = spark.createDataFrame([("chr1", a, b, 0.0, k + 1) for k, (a, b) in enumerate(ranked)], "chrom string, st long, ed long, z double, rank int")
    found = {r["rank"]: r["mbic"] for r in segment.model_scores(fit, table).collect()}
    for k in (1, 2, 3):
        assert found[k] == pytest.approx(plain_score(y, yhat, ranked[:k]), abs=2e-3)
