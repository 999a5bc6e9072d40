"""Outlier smoothing and circular binary segmentation of one series, with a fixed seed.

An arc splits a series if a difference as large from the rest is rare without any breakpoint: for short series by
PERMUTATIONS permutations, for longer ones by permutations for short arcs and by the published approximation of the
tail probability for long arcs.
"""

from __future__ import annotations

import math

import numpy as np

PERMUTATIONS, ALPHA = 10_000, 0.01
#: From this many points on, arcs longer than SHORT_ARC (and that much shorter than the series) go by the tail probability.
LONG_SERIES, SHORT_ARC = 200, 25
#: Numbers in a batch of permutations.
BATCH = 1 << 20


def smooth_outliers(x: np.ndarray, region: int = 10, outlier: float = 4.0, smooth: float = 2.0, trim: float = 0.025) -> np.ndarray:
    """Points beyond `outlier` deviations of all neighbours within `region` move to `smooth` deviations of their median."""
    n = len(x)
    if n < 3:
        return x.copy()
    steps = np.sort(np.diff(x) ** 2)[: max(1, int(np.ceil((1 - 2 * trim) * (n - 1))))]
    sd = np.sqrt(steps.mean() / 2) or 1e-12
    out = x.copy()
    for i in range(n):
        around = np.concatenate([x[max(0, i - region) : i], x[i + 1 : i + 1 + region]])
        over, under = x[i] - around.max(), around.min() - x[i]
        if over > outlier * sd or under > outlier * sd:
            centre = np.median(np.append(around, x[i]))
            out[i] = centre + smooth * sd * (1 if over > under else -1)
    return out


def arcs(sums: np.ndarray, length: int, min_width: int) -> tuple[np.ndarray, np.ndarray]:
    """First points of the arcs of one length, and their between-group sums of squares for each row of running sums.

    An arc leaves min_width points or none on either side.
    """
    n = sums.shape[1] - 1
    first = np.unique(np.concatenate([[0], np.arange(min_width, n - length - min_width + 1), [n - length]]))
    return first, (sums[:, first + length] - sums[:, first]) ** 2 * (n / (length * (n - length)))


def running(rows: np.ndarray) -> np.ndarray:
    """Running sums of each row about its mean, from 0."""
    return np.pad(np.cumsum(rows - rows.mean(axis=1, keepdims=True), axis=1), ((0, 0), (1, 0)))


def best_arc(x: np.ndarray, min_width: int) -> tuple[float, int, int]:
    """Largest between-group sum of squares of an arc i..j-1 against the rest, both of min_width points at least; the first arc on ties."""
    n, sums = len(x), running(x[None, :])
    best = (0.0, 0, n)
    for length in range(min_width, n - min_width + 1):
        first, found = arcs(sums, length, min_width)
        at = int(np.argmax(found[0]))
        value, i, j = float(found[0, at]), int(first[at]), int(first[at]) + length
        if value > best[0] or value == best[0] and (i, j) < best[1:]:
            best = value, i, j
    return best


def _nu(x: np.ndarray) -> np.ndarray:
    """The overshoot correction of boundary crossings, in its usual closed approximation."""
    phi = np.exp(-(x**2) / 8) / math.sqrt(2 * math.pi)
    capital = np.array([0.5 * (1 + math.erf(v / 2 / math.sqrt(2))) for v in x])
    return (2 / x) * (capital - 0.5) / (x / 2 * capital + phi)


def tail_probability(b: float, n: int, shortest: int, steps: int = 200) -> float:
    """Chance that a series of n points without a breakpoint has an arc of shortest..n - shortest points with a standardised difference of b.

    The approximation for the largest of such differences, summed over the share t of points in the arc.
    """
    if b <= 0:
        return 1.0
    edges = np.linspace(shortest / n, 0.5, steps + 1)
    t = (edges[1:] + edges[:-1]) / 2
    inner = (_nu(b / np.sqrt(n * t * (1 - t))) / (t * (1 - t))) ** 2
    # Symmetric about t = 1/2, and in the sign of the difference.
    integral = 2 * float(inner.sum() * (edges[1] - edges[0]))
    return min(1.0, b**3 * math.exp(-b * b / 2) / math.sqrt(2 * math.pi) / 4 * integral)


def is_rare(x: np.ndarray, largest: float, min_width: int, rng: np.random.Generator, alpha: float = ALPHA, permutations: int = PERMUTATIONS) -> bool:
    """Whether under alpha of the series without a breakpoint have an arc of such a sum of squares.

    Permutations stop as soon as too many reach it.
    """
    n = len(x)
    lengths = range(min_width, n - min_width + 1)
    most = alpha
    if n >= LONG_SERIES:
        rest = max(float(np.sum((x - x.mean()) ** 2)) - largest, 1e-12)
        most -= tail_probability(math.sqrt(largest / (rest / (n - 2))), n, SHORT_ARC + 1)
        lengths = [k for k in lengths if min(k, n - k) <= SHORT_ARC]
    over, done, size = 0, 0, 50
    while done < permutations:
        if over > most * permutations:
            return False
        size = min(2 * size, permutations - done, max(1, BATCH // n))
        sums = running(rng.permuted(np.broadcast_to(x, (size, n)), axis=1))
        found = np.zeros(size)
        for length in lengths:
            np.maximum(found, arcs(sums, length, min_width)[1].max(axis=1), out=found)
        over, done = over + int((found >= largest * (1 - 1e-12)).sum()), done + size
    return over <= most * permutations


def segment(x: np.ndarray, min_width: int = 5, alpha: float = ALPHA, permutations: int = PERMUTATIONS, seed: int = 0) -> list[int]:
    """First points of the segments."""
    rng, borders = np.random.default_rng(seed), {0}
    todo = [(0, len(x))]
    while todo:
        a, b = todo.pop()
        part = x[a:b]
        if len(part) < 2 * min_width or np.ptp(part) == 0:
            continue
        largest, i, j = best_arc(part, min_width)
        if largest <= 0 or not is_rare(part, largest, min_width, rng, alpha, permutations):
            continue
        inner = sorted({0, i, j, len(part)})
        borders.update(a + c for c in inner[:-1])
        todo += [(a + c, a + d) for c, d in zip(inner, inner[1:])][::-1]
    return sorted(borders)
