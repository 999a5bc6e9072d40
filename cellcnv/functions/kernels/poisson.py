"""Batches of small Poisson regressions without an intercept, and log densities."""

from __future__ import annotations

import math

import numpy as np


def log_factorials(counts: np.ndarray) -> np.ndarray:
    values, of = np.unique(counts, return_inverse=True)
    return np.array([math.lgamma(v + 1) for v in values.tolist()])[of].reshape(np.shape(counts))


def log_density(counts: np.ndarray, mean: np.ndarray, factorials: np.ndarray) -> np.ndarray:
    return counts * np.log(np.maximum(mean, 1e-300)) - mean - factorials


def regress(y: np.ndarray, x: np.ndarray, offset: np.ndarray, rounds: int = 25, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of each row of y on x (n x k) with an offset per entry, and whether the row's fit worked.

    Iteratively weighted least squares; all rows take their steps together and stop one by one.
    """
    rows, k = len(y), x.shape[1]
    beta, ok, active = np.zeros((rows, k)), np.ones(rows, bool), np.ones(rows, bool)
    mu = y + 0.1
    eta = np.log(mu)
    deviance = np.full(rows, np.inf)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            a = np.flatnonzero(active)
            if not len(a):
                break
            z = eta[a] - offset[a] + (y[a] - mu[a]) / mu[a]
            normal = np.einsum("rn,nk,nl->rkl", mu[a], x, x)
            right = np.einsum("rn,nk->rk", mu[a] * z, x)
            normal += 1e-12 * np.trace(normal, axis1=1, axis2=2)[:, None, None] * np.eye(k)
            good = np.isfinite(normal).all(axis=(1, 2)) & np.isfinite(right).all(axis=1) & (np.abs(np.linalg.det(np.where(np.isfinite(normal), normal, 0))) > 0)
            ok[a[~good]] = active[a[~good]] = False
            a, normal, right = a[good], normal[good], right[good]
            if not len(a):
                break
            beta[a] = np.linalg.solve(normal, right[:, :, None])[:, :, 0]
            eta[a] = beta[a] @ x.T + offset[a]
            mu[a] = np.exp(eta[a])
            new = 2 * np.where(y[a] > 0, y[a] * np.log(np.where(y[a] > 0, y[a], 1) / mu[a]), 0).sum(axis=1) - 2 * (y[a] - mu[a]).sum(axis=1)
            bad = ~np.isfinite(new)
            ok[a[bad]] = active[a[bad]] = False
            done = np.abs(new - deviance[a]) / (np.abs(new) + 0.1) < tolerance
            deviance[a] = new
            active[a[done]] = False
    return beta, ok


def least_squares(y: np.ndarray, x: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The stand-in for rows whose fit failed: log counts on x, with the logarithm of the (already logged) offset.

    Kept from the published method. Entries whose offset has no logarithm are left out; nothing left gives zero.
    """
    with np.errstate(all="ignore"):
        target = np.log(np.maximum(y, 1)) - np.log(offset)
    out = np.zeros((len(y), x.shape[1]))
    for r, t in enumerate(target):
        use = np.isfinite(t)
        if use.sum() >= x.shape[1]:
            out[r] = np.linalg.lstsq(x[use], t[use], rcond=None)[0]
    return out
