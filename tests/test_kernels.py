import numpy as np
import pytest

from cellcnv.functions.kernels import cbs, em, poisson, segments
from cellcnv.functions.kernels.loess import Loess
from cellcnv.functions.kernels.spline import SmoothingSpline


def test_loess_keeps_quadratics_and_is_linear():
    x = np.sort(np.random.default_rng(0).uniform(30, 70, 120))
    fit = Loess(x)
    y = 1 + 0.02 * (x - 50) - 0.001 * (x - 50) ** 2
    assert np.allclose(fit.fit(y), y)
    noise = np.random.default_rng(1).normal(size=120)
    assert np.allclose(fit.fit(y + 2 * noise), fit.fit(y) + 2 * fit.fit(noise))
    assert np.isnan(fit.predict(y, np.array([10.0]))).all()


def test_loess_close_to_direct_local_regression():
    rng = np.random.default_rng(2)
    x = np.sort(rng.uniform(0, 1, 100))
    y = np.sin(4 * x) + rng.normal(0, 0.1, 100)
    direct = []
    for v in x:
        d = np.abs(x - v)
        w = np.clip(1 - (d / np.partition(d, 74)[74]) ** 3, 0, None) ** 1.5
        direct.append(np.linalg.lstsq(np.stack([np.ones(100), x - v, (x - v) ** 2], 1) * w[:, None], y * w, rcond=None)[0][0])
    assert np.abs(Loess(x).fit(y) - direct).max() < 0.02


def test_spline_keeps_lines_and_smooths():
    rng = np.random.default_rng(3)
    x = np.repeat(np.sort(rng.uniform(30, 70, 60)), 2)
    spline = SmoothingSpline(x)
    assert np.allclose(spline.fit(3 * x + 1), 3 * x + 1, atol=1e-5)
    y = np.sin(x / 8)
    assert np.abs(spline.fit(y + rng.normal(0, 0.1, 120)) - y).mean() < 0.06


def test_poisson_regression_recovers_coefficients():
    rng = np.random.default_rng(4)
    x, offset = rng.normal(size=(400, 2)), rng.normal(3, 0.1, (3, 400))
    beta, ok = poisson.regress(rng.poisson(np.exp(x @ [0.3, -0.2] + offset)).astype(float), x, offset)
    assert ok.all() and np.allclose(beta, [0.3, -0.2], atol=0.03)


def test_em_rows_sum_to_one_and_states_are_found():
    rng = np.random.default_rng(5)
    gc = np.sort(rng.uniform(30, 60, 200))
    truth = np.repeat([2, 3, 2, 1], 50)
    offset = np.full(200, 100.0)
    counts = rng.poisson(offset * truth / 2).astype(float)
    smoother = Loess(gc)
    fits = em.fit_cell(counts, counts / offset, offset, truth.astype(float), gc, smoother, smoother.degrees(), [1, 2, 3, 4], 20)
    assert all(np.allclose(f["z"].sum(axis=1), 1) for f in fits)
    best, copies = em.winner(fits)
    assert best["t"] >= 3 and np.mean(copies == truth) > 0.9


def test_segmentation_finds_a_planted_arc():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.1, 30), rng.normal(1, 0.1, 20), rng.normal(0, 0.1, 30)])
    assert cbs.segment(cbs.smooth_outliers(x)) == [0, 30, 50]
    assert cbs.segment(np.zeros(40)) == [0]


def test_best_arc_is_the_largest_of_all():
    rng = np.random.default_rng(12)
    for n, width in ((12, 3), (25, 5), (10, 5)):
        x = rng.normal(size=n)
        found = {}
        for i in range(n):
            for j in range(i + width, n + 1):
                if n - (j - i) >= width and (i == 0 or i >= width) and (j == n or n - j >= width):
                    inside, outside = x[i:j], np.concatenate([x[:i], x[j:]])
                    found[i, j] = ((x - x.mean()) ** 2).sum() - ((inside - inside.mean()) ** 2).sum() - ((outside - outside.mean()) ** 2).sum()
        value, i, j = cbs.best_arc(x, width)
        assert value == pytest.approx(max(found.values())) and found[i, j] == pytest.approx(value)


def test_a_breakpoint_near_the_border_of_significance_is_found_with_every_seed():
    rng, p = np.random.default_rng(1), 1.0
    while not 0.004 < p < 0.006:
        x = np.concatenate([rng.normal(0, 1, 20), rng.normal(1.3, 1, 20)])
        largest = cbs.best_arc(x, 5)[0]
        over = np.zeros(20_000)
        sums = cbs.running(rng.permuted(np.broadcast_to(x, (20_000, 40)), axis=1))
        for length in range(5, 36):
            over = np.maximum(over, cbs.arcs(sums, length, 5)[1].max(axis=1))
        p = (over >= largest).mean()
    assert all(len(cbs.segment(x, seed=seed)) > 1 for seed in range(50))


def test_false_breakpoints_are_as_rare_as_asked():
    rng = np.random.default_rng(2)
    for n, series in ((30, 300), (260, 100)):
        found = sum(len(cbs.segment(rng.normal(size=n), alpha=0.05, permutations=1000, seed=k)) > 1 for k in range(series))
        assert 0.01 * series <= found <= 0.1 * series


def test_tail_probability_agrees_with_simulation():
    rng, n, shortest = np.random.default_rng(3), 220, 26
    sums, largest = cbs.running(rng.normal(size=(3000, n))), np.zeros(3000)
    for length in range(shortest, n - shortest + 1):
        largest = np.maximum(largest, cbs.arcs(sums, length, 1)[1].max(axis=1))
    for share in (0.9, 0.97, 0.99):
        assert cbs.tail_probability(float(np.sqrt(np.quantile(largest, share))), n, shortest) == pytest.approx(1 - share, rel=0.35)


def test_long_series_are_segmented():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.2, 300), rng.normal(0.5, 0.2, 12), rng.normal(0, 0.2, 200), rng.normal(-0.3, 0.2, 300)])
    found = cbs.segment(x)
    assert len(found) == 4 and np.abs(np.array(found) - [0, 300, 312, 512]).max() <= 3


def test_window_sums_against_brute_force():
    rng = np.random.default_rng(7)
    y, lam = rng.poisson(50, (3, 12)).astype(float), rng.uniform(40, 60, (3, 12))
    found = {(i, int(b)): v for part in range(3) for i, j, z in segments.window_sums(y, lam, part, 3) for b, v in zip(j, z)}
    assert len(found) == 66
    for (a, b), value in found.items():
        parts = [slice(0, a), slice(a, b + 1), slice(b + 1, 12)]
        assert value == pytest.approx(sum(segments.likelihood_part(y[:, p].sum(1), lam[:, p].sum(1)).sum() for p in parts))


@pytest.mark.parametrize(
    ("windows", "before", "after", "want"),
    [
        ([], True, True, ([(1, 20)], 0)),
        ([[3, 9, 60.0], [10, 15, 20.0]], False, False, ([(1, 2), (3, 9), (10, 15), (16, 20)], 1)),
        ([[3, 9, 60.0], [10, 15, 20.0]], True, False, ([(1, 9), (10, 15), (16, 20)], 1)),
        ([[3, 9, 60.0], [10, 15, 20.0]], False, True, ([(1, 2), (3, 9), (10, 20)], 1)),
        ([[2, 9, 50.0], [11, 20, 40.0]], False, False, ([(1, 9), (10, 20)], 1)),  # a flank of one bin; the gap of one bin goes to the later row
        ([[11, 20, 50.0], [2, 9, 40.0]], False, False, ([(1, 10), (11, 20)], 1)),
        ([[8, 12, 50.0]], False, False, ([(1, 7), (8, 12), (13, 20)], 0)),  # no window longer than five bins past its first: not searched again
        ([[1, 20, 50.0]], False, False, ([(1, 20)], 0)),  # the whole range
        ([[1, 19, 50.0]], False, False, ([(1, 20)], 0)),  # all but one bin
        ([[1, 7, 9.0], [9, 15, 9.0], [17, 20, 9.0]], False, False, ([(1, 7), (8, 15), (16, 20)], 0)),  # equal statistics
    ],
)
def test_borders_are_repaired(windows, before, after, want):
    assert segments.repaired(windows, 1, 20, before, after) == want


def test_a_range_of_two_bins_is_one_segment():
    assert segments.repaired([[4, 5, 50.0]], 4, 5, False, False) == ([(4, 5)], 0)
