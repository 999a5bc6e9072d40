"""Choice of windows on the scan statistic, and the model score of the chosen segments."""

from __future__ import annotations

import math

import numpy as np

#: Of each border: the difference of the score's two published constants.
BORDER_COST = 3 / 2 - 2.27
#: Windows that stay must be longer than this many bins past their first, with a statistic over LEAST_Z.
LEAST_LENGTH, LEAST_Z = 1, 10.0
#: Ranges whose longest window is no longer aren't searched again.
SHORT = 5


def likelihood_part(y: np.ndarray, lam: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.rint(2 * y / lam)
    c = np.where(np.isfinite(c), c, 2.0)
    return (1 - c / 2) * lam + np.log((c + 1e-4) / 2.0001) * y


def clip(y: np.ndarray, lam: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells x bins with low expectations raised to the floor; counts too, on all such bins of a cell if one of them is low."""
    low = lam < floor
    any_low = (low & (y < floor)).any(axis=1, keepdims=True)
    return np.where(low & any_low, floor, y), np.where(low, floor, lam)


def window_sums(y: np.ndarray, lam: np.ndarray, part: int = 0, parts: int = 1):
    """For each first bin (from 0) of one part of them: that bin, the last bins and the statistic of its windows, summed over cells."""
    n = y.shape[1]
    sy, sl = (np.vstack([np.zeros(len(v)), np.cumsum(v.T, axis=0)]) for v in (y, lam))
    for i in range(part, n - 1, parts):
        j = np.arange(i + 1, n)
        z = likelihood_part(sy[j + 1] - sy[i], sl[j + 1] - sl[i]) + likelihood_part(sy[i], sl[i]) + likelihood_part(sy[-1] - sy[j + 1], sl[-1] - sl[j + 1])
        yield i, j, z.sum(axis=1)


def holds_more(windows: list[list[float]], start: int, end: int) -> bool:
    """Whether a range with these windows is worth another search inside them."""
    if not windows:
        return False
    lengths = [b - a for a, b, _ in windows]
    whole = len(windows) == 1 and (windows[0][0], windows[0][1]) == (start, end)
    all_equal = len(windows) > 2 and len({z for *_, z in windows}) == 1
    all_but_one = len(windows) == 1 and (end - start) - lengths[0] == 1
    return not (whole or all_equal or max(lengths) <= SHORT or all_but_one)


def reach_border(windows: list[list[float]], border: int, side: int, positive: bool) -> list[list[float]]:
    """The windows so that they reach one end of the range: side 0 its start, side 1 its end.

    A flank of one bin, or with a positive statistic, goes to the outermost window. Any other becomes a row of its
    own: first in the list before the start, last in it behind the end.
    """
    inwards = 1 - 2 * side
    outermost = min(windows, key=lambda w: inwards * w[side])
    missing = inwards * (outermost[side] - border)
    if missing == 1 or missing and positive:
        outermost[side] = border
    elif missing:
        flank = [*sorted((border, outermost[side] - inwards)), 0.0]
        return [*windows, flank] if side else [flank, *windows]
    return windows


def close_single_gaps(windows: list[list[float]]) -> None:
    """A gap of one bin goes to the neighbour that stands later in the list."""
    ending = {w[1]: place for place, w in enumerate(windows)}
    for place, right in enumerate(windows):
        before = ending.get(right[0] - 2)
        if before is not None:
            gap = right[0] - 1
            if before > place:
                windows[before][1] = gap
            else:
                right[0] = gap


def tile(pairs: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """The pairs in order with the gaps before, between and after them."""
    out, at = [], start
    for a, b in sorted(pairs):
        if a > at:
            out.append((at, a - 1))
        out.append((a, b))
        at = b + 1
    if at <= end:
        out.append((at, end))
    return out


def strong(i: np.ndarray, j: np.ndarray, z: np.ndarray) -> np.ndarray:
    return (j - i > LEAST_LENGTH) & (z > LEAST_Z)


def repaired(windows: list[list[float]], start: int, end: int, before: bool, after: bool) -> tuple[list[tuple[int, int]], int]:
    """Segments that tile start..end, and whether to search inside them.

    windows: the strong ones of those chosen, by falling statistic. before, after: whether the flanks outside all
    windows have a positive statistic.
    """
    if end - start < 2:
        return [(start, end)], 0
    nested = int(holds_more(windows, start, end))
    if not windows:
        return [(start, end)], nested
    windows = reach_border([list(w) for w in windows], start, 0, before)
    windows = reach_border(windows, end, 1, after)
    close_single_gaps(windows)
    return tile([(a, b) for a, b, _ in windows], start, end), nested


def cell_shares(y: np.ndarray, yhat: np.ndarray, ranked: list[tuple[int, int]]) -> list[tuple[int, int, float, float, float, int]]:
    """One cell's part of the score after each rank: rows (rank, border, loglik, carrier, squared jump, inner borders).

    Kept from the published method: the first mean is of counts and the others of expectations, only the first
    ratio is doubled, all lengths but the first count one more, and a single inner border takes the plain jump.
    """
    n, out = len(y), []
    y0, yhat0 = np.maximum(y, 20), np.maximum(yhat, 20)
    sums = {k: np.concatenate([[0.0], np.cumsum(v)]) for k, v in (("y0", y0), ("yhat0", yhat0), ("y", y), ("yhat", yhat))}
    between = lambda k, a, b: sums[k][b] - sums[k][a]  # noqa: E731  over bins a+1..b
    for s in range(1, len(ranked) + 1):
        borders = sorted({1, n, *(x for pair in ranked[:s] for x in pair)})
        inner = len(borders) - 2
        if inner <= 0:
            out.append((s, 0, 0.0, 0.0, 0.0, 0))
            continue
        first = borders[1]
        means = [np.rint(between("y0", 0, first) / first)]
        ratios = [np.rint(2 * between("y0", 0, first) / between("yhat0", 0, first))]
        for a, b in zip(borders[1:], borders[2:]):
            means.append(np.rint(between("yhat0", a, b) / (b - a + 1)))
            ratios.append(np.rint(between("y0", a, b) / between("yhat0", a, b)))
        loglik = 0.0
        for a, b in tile(ranked[:s], 1, n):
            total, lam = between("y", a - 1, b), between("yhat", a - 1, b)
            if lam < 20:
                total = lam = 20.0
            c = np.rint(2 * total / lam)
            loglik += (1 - c / 2) * lam + math.log((c + 1e-4) / 2.0001) * total
        for r in range(inner):
            carrier = float(ratios[r + 1] != ratios[r])
            jump = float(means[r + 1] - means[r]) * (1.0 if inner == 1 else carrier)
            out.append((s, r, loglik if r == 0 else 0.0, carrier, jump * jump, inner))
    return out


def modified_bic(loglik: float, carriers: float, jump: float, inner: int, cells: int, bins: int) -> float:
    """The modified BIC for breakpoints that cells share, after its published form; 0 without an inner border.

    From the log likelihood ratio come off: what fitting a level to each carrier costs, the number of ways to place
    the borders, the size of the jumps, a constant for each border, and the entropy of who carries which border.
    """
    if inner <= 0:
        return 0.0
    if carriers > 0 and loglik <= 0:
        return math.nan
    levels = carriers / 2 * (1 + math.log(2 * loglik / carriers)) if carriers else 0.0
    # By lgamma, so that the binomial coefficient can't overflow.
    placements = math.lgamma(bins + 1) - math.lgamma(inner + 1) - math.lgamma(bins - inner + 1)
    possible = cells * inner
    share = carriers / possible
    entropy = -(carriers * math.log(share) + (possible - carriers) * math.log(1 - share)) if 0 < share < 1 else 0.0
    return round(loglik - levels - placements - math.log(max(jump, 1.0)) - inner * BORDER_COST - entropy, 3)
