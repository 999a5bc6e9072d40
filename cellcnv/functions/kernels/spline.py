"""Cubic smoothing spline with the penalty chosen by generalised cross-validation.

Everything that depends on x alone is made once: basis, penalty and their joint eigenvectors. Per y only the
search over the penalty is left.
"""

from __future__ import annotations

import numpy as np

# Numbers of knots at 50, 200, 800 and 3200 distinct points.
KNOTS_AT = [(50, 50), (200, 100), (800, 140), (3200, 200)]


def n_knots(n: int) -> int:
    """All points up to 50 of them, then more and more slowly growing, log-linear between fixed points."""
    if n < KNOTS_AT[0][0]:
        return n
    for (n0, k0), (n1, k1) in zip(KNOTS_AT, KNOTS_AT[1:]):
        if n < n1:
            return int(2 ** (np.log2(k0) + (np.log2(k1) - np.log2(k0)) * (n - n0) / (n1 - n0)))
    return int(200 + (n - 3200) ** 0.2)


def basis(knots: np.ndarray, x: np.ndarray, degree: int = 3) -> np.ndarray:
    """B-splines of a degree by the recursion over degrees; the last interval is closed."""
    x = np.asarray(x, float)
    last = np.searchsorted(knots, knots[-1], side="left") - 1
    cell = np.clip(np.searchsorted(knots, x, side="right") - 1, degree, last)
    values = np.zeros((len(x), len(knots) - 1))
    values[np.arange(len(x)), cell] = 1.0
    for d in range(1, degree + 1):
        width = knots[d:] - knots[:-d]
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(width[:-1] > 0, (x[:, None] - knots[None, : -d - 1]) / width[:-1], 0.0)
            right = np.where(width[1:] > 0, (knots[None, d + 1 :] - x[:, None]) / width[1:], 0.0)
        values = left * values[:, : left.shape[1]] + right * values[:, 1 : right.shape[1] + 1]
    return values


def curvature(knots: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Second derivatives of the cubic B-splines: twice the difference rule."""
    values = basis(knots, x, 1)
    for d in (2, 3):
        width = knots[d:] - knots[:-d]
        scaled = np.divide(d * values, width[: values.shape[1]], out=np.zeros_like(values), where=width[: values.shape[1]] > 0)
        values = scaled[:, :-1] - scaled[:, 1:]
    return values


class SmoothingSpline:
    def __init__(self, x: np.ndarray):
        x = np.asarray(x, float)
        quartile = np.subtract(*np.quantile(x, [0.75, 0.25])) or 1.0
        _, first, self.of = np.unique(np.round((x - x.mean()) / (1e-6 * quartile)), return_index=True, return_inverse=True)
        self.distinct = x[first]
        self.weight = np.bincount(self.of).astype(float)
        n = len(self.distinct)
        if n < 4:
            raise ValueError("too few distinct points to smooth")
        scaled = (self.distinct - self.distinct[0]) / (self.distinct[-1] - self.distinct[0])
        inner = scaled[np.unique(np.linspace(0, n - 1, n_knots(n)).round().astype(int))]
        knots = np.concatenate([[inner[0]] * 3, inner, [inner[-1]] * 3])
        design = basis(knots, scaled)
        penalty = np.zeros((design.shape[1],) * 2)
        for a, b in zip(inner, inner[1:]):
            # The product of two linear pieces is quadratic: three points integrate it exactly.
            for at, share in ((a, 1 / 6), ((a + b) / 2, 4 / 6), (b, 1 / 6)):
                c = curvature(knots, np.array([min(max(at, a + 1e-12), b - 1e-12)]))[0]
                penalty += share * (b - a) * np.outer(c, c)
        gram = design.T @ (self.weight[:, None] * design)
        root = np.linalg.cholesky(gram + 1e-10 * np.trace(gram) / len(gram) * np.eye(len(gram)))
        inverse = np.linalg.inv(root)
        self.values, vectors = np.linalg.eigh(inverse @ penalty @ inverse.T)
        self.values = np.maximum(self.values, 0)
        self.smooth = design @ inverse.T @ vectors
        positive = self.values[self.values > 1e-9 * max(self.values.max(), 1e-30)]
        self.penalties = np.exp(np.linspace(np.log(1e-4 / positive.max()), np.log(1e4 / positive.min()), 160)) if len(positive) else np.array([0.0])

    def fit(self, y: np.ndarray) -> np.ndarray:
        """Smooth of y at the points of x."""
        mean = np.bincount(self.of, y) / self.weight
        coded = self.smooth.T @ (self.weight * mean)
        n = len(y)
        within = np.sum((y - mean[self.of]) ** 2)
        shrink = 1 / (1 + self.penalties[:, None] * self.values[None, :])
        fitted = (shrink * coded) @ self.smooth.T
        rss = within + ((mean - fitted) ** 2 * self.weight).sum(axis=1)
        score = rss / n / (1 - np.minimum(shrink.sum(axis=1), n - 1e-6) / n) ** 2
        return fitted[int(np.argmin(score))][self.of]
