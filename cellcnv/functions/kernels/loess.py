"""Local quadratic regression on one variable, as a linear operator that depends on x only.

Local fits are made at the corners of cells that hold few points and joined by cubic Hermite pieces.
"""

from __future__ import annotations

import numpy as np

SPAN, CELL = 0.75, 0.2
#: Up to this many points the degrees of freedom come from the whole operator.
EXACT_POINTS = 2500


def corners(x: np.ndarray) -> np.ndarray:
    """Cell borders: cells with more points than span * CELL * n are cut at their median."""
    ordered = np.sort(x)
    low, high = ordered[0], ordered[-1]
    margin = 0.005 * max(high - low, 1e-3 * max(abs(low), abs(high)) + 1e-30)
    few = max(1, int(len(x) * SPAN * CELL))
    out = {low - margin, high + margin}

    def cut(a: int, b: int, left: float, right: float):
        if b - a <= few:
            return
        m = (a + b) // 2
        at = (ordered[m - 1] + ordered[m]) / 2
        if not left < at < right:
            return
        out.add(at)
        cut(a, m, left, at)
        cut(m, b, at, right)

    cut(0, len(x), low - margin, high + margin)
    return np.array(sorted(out))


class Loess:
    """fit(y) gives the smooth at the points of x; predict(y, at) elsewhere, NaN beyond the range of x."""

    def __init__(self, x: np.ndarray):
        self.x = np.asarray(x, float)
        n = len(self.x)
        if n < 4:
            raise ValueError("too few points to smooth")
        self.knots = corners(self.x)
        q = min(n, int(n * SPAN + 1e-5))
        rows = []
        for v in self.knots:
            d = np.abs(self.x - v)
            reach = max(np.partition(d, q - 1)[q - 1], 1e-12)
            w = np.where(d < 0.999 * reach, (1 - np.minimum(1, d / reach) ** 3) ** 3, 0.0)
            w[d <= 0.001 * reach] = 1.0
            root = np.sqrt(w)
            design = np.stack([np.ones(n), self.x - v, (self.x - v) ** 2], axis=1) * root[:, None]
            rows.append(np.linalg.pinv(design, rcond=1e-10)[:2] * root)
        rows = np.array(rows)
        self.local = np.concatenate([rows[:, 0], rows[:, 1]])
        self.basis = self.blend(self.x)

    def blend(self, at: np.ndarray) -> np.ndarray:
        """Weights of the corners' values and slopes at each point."""
        k = len(self.knots)
        cell = np.clip(np.searchsorted(self.knots, at, side="right") - 1, 0, k - 2)
        a, b = self.knots[cell], self.knots[cell + 1]
        h, t = b - a, (at - a) / (b - a)
        out, row = np.zeros((len(at), 2 * k)), np.arange(len(at))
        out[row, cell], out[row, cell + 1] = (1 - t) ** 2 * (1 + 2 * t), t**2 * (3 - 2 * t)
        out[row, k + cell], out[row, k + cell + 1] = h * t * (1 - t) ** 2, -h * t**2 * (1 - t)
        return out

    def fit(self, y: np.ndarray) -> np.ndarray:
        return self.basis @ (self.local @ y)

    def predict(self, y: np.ndarray, at: np.ndarray) -> np.ndarray:
        inside = (at >= self.x.min()) & (at <= self.x.max())
        return np.where(inside, self.blend(at) @ (self.local @ y), np.nan)

    def degrees(self) -> float:
        """Look-up degrees of freedom of the residuals; for many points their first moment alone."""
        n = len(self.x)
        if n <= EXACT_POINTS:
            rest = np.eye(n) - self.basis @ self.local
            square = rest @ rest.T
            return float(np.trace(square) ** 2 / np.sum(square * square))
        trace = np.sum(self.basis * self.local.T)
        gram = (self.local @ self.local.T) * (self.basis.T @ self.basis)
        return float(n - 2 * trace + gram.sum())


def positive(f: np.ndarray) -> np.ndarray:
    """Values that are missing or not positive become the smallest positive one."""
    good = np.isfinite(f) & (f > 0)
    return np.where(good, f, f[good].min() if good.any() else 1e-12)
