"""Expectation-maximisation over copy states of the GC curve of one cell, and its parts for clones."""

from __future__ import annotations

import numpy as np

from .loess import Loess, positive
from .poisson import log_density, log_factorials

LEAST_ROUNDS, MOST_ROUNDS = 3, 49
CURVE_CHANGE, STATE_CHANGE = 5e-6, 0.005
MAD_SCALE = 1.4826


def outlier_bins(ratio: np.ndarray, counts: np.ndarray, smoother: Loess, min_count: float) -> np.ndarray:
    """Bins far from the smooth or with few reads; if there are none, the one with the largest ratio."""
    away = np.abs(ratio - positive(smoother.fit(ratio)))
    centre = np.median(away)
    out = (away > centre + 5 * MAD_SCALE * np.median(np.abs(away - centre))) | (counts < min_count)
    if not out.any():
        out[np.argmax(ratio)] = True
    return out


def start_states(alpha: np.ndarray, t: int) -> np.ndarray:
    """One-hot states: the rounded copy number, within 1..t."""
    state = np.clip(np.rint(alpha), 1, t).astype(int)
    return np.eye(t)[state - 1]


def copies(z: np.ndarray) -> np.ndarray:
    """Half the expected copy number."""
    return z @ (np.arange(1, z.shape[1] + 1) / 2)


def start_curve(ratio: np.ndarray, gc: np.ndarray, keep: np.ndarray, z: np.ndarray | None) -> np.ndarray:
    """The smooth from the kept bins, at all bins."""
    y = ratio if z is None else ratio / copies(z)
    return positive(Loess(gc[keep]).predict(y[keep], gc))


def curve(ratio: np.ndarray, smoother: Loess, z: np.ndarray) -> np.ndarray:
    return positive(smoother.fit(ratio / copies(z)))


def state_log_densities(counts: np.ndarray, factorials: np.ndarray, base: np.ndarray, t: int) -> np.ndarray:
    """bins x t log densities at base * s / 2."""
    return np.stack([log_density(counts, base * s / 2, factorials) for s in range(1, t + 1)], axis=1)


def responsibilities(log_p: np.ndarray, share: np.ndarray) -> np.ndarray:
    log_p = log_p + np.log(np.where(share == 0, 1e-100, share))
    p = np.exp(log_p - log_p.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def goes_on(rounds_done: int, curve_change: float, state_change: float) -> bool:
    """Whether another round follows."""
    return rounds_done < MOST_ROUNDS and (rounds_done < LEAST_ROUNDS or curve_change > CURVE_CHANGE or state_change > STATE_CHANGE)


def score(loglik: float, n: int, degrees: float, t: int) -> float:
    return 2 * loglik - (n - degrees + (t - 1 if t > 1 else 0)) * np.log(n)


def fit_cell(counts: np.ndarray, ratio: np.ndarray, offset: np.ndarray, alpha: np.ndarray, gc: np.ndarray, smoother: Loess, degrees: float, states: list[int], min_count: float) -> list[dict]:
    """For each number of states: loglik, bic, curve, responsibilities and shares."""
    keep = ~outlier_bins(ratio, counts, smoother, min_count)
    factorials, n, out = log_factorials(counts), len(counts), []
    for t in states:
        z = start_states(np.maximum(1, np.rint(alpha)), t) if t > 1 else np.ones((n, 1))
        share = z.mean(axis=0)
        f = start_curve(ratio, gc, keep, z if t > 1 else None)
        done, df, dz = 0, np.inf, np.inf
        while t > 1 and goes_on(done, df, dz):
            new_f, share = curve(ratio, smoother, z), z.mean(axis=0)
            new_z = responsibilities(state_log_densities(counts, factorials, offset * new_f, t), share)
            df, dz = np.mean((f - new_f) ** 2), np.mean((new_z - z) ** 2)
            f, z, done = new_f, new_z, done + 1
        mean = offset * f * (copies(z) if t > 1 else 1.0)
        loglik = float(log_density(counts, mean, factorials)[keep].sum())
        out.append({"t": t, "loglik": loglik, "bic": float(score(loglik, n, degrees, t)), "curve": f, "z": z, "share": share})
    return out


def winner(fits: list[dict]) -> tuple[dict, np.ndarray]:
    """The fit with the largest score and the copy numbers: 2 everywhere if it stands first, else the likeliest state."""
    at = int(np.argmax([f["bic"] for f in fits]))
    z = fits[at]["z"]
    return fits[at], np.full(len(z), 2.0) if at == 0 else z.argmax(axis=1) + 1.0
