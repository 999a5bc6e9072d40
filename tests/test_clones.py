"""Copy states shared by the cells of a clone, against a plain version over matrices."""

import math

import numpy as np
import pytest

from cellcnv.functions.kernels.loess import Loess
from cellcnv.operators import em


def positive(f):
    good = np.isfinite(f) & (f > 0)
    return np.where(good, f, f[good].min())


def plain(counts, ratio, offset, alpha, gc, states, min_count):
    """Curves (bins x cells) and copy numbers of one clone: matrices have a column per cell."""
    n, cells = counts.shape
    smoother = Loess(gc)
    bad = np.zeros(n, bool)
    for j in range(cells):
        away = np.abs(ratio[:, j] - positive(smoother.fit(ratio[:, j])))
        own = (away > np.median(away) + 5 * 1.4826 * np.median(np.abs(away - np.median(away)))) | (counts[:, j] < min_count)
        if not own.any():
            own[ratio[:, j].argmax()] = True
        bad |= own
    log_factorial = np.vectorize(lambda y: math.lgamma(y + 1))(counts)
    results = []
    for t in states:
        if t == 1:
            z, f = np.ones((n, 1)), np.stack([positive(Loess(gc[~bad]).predict(ratio[~bad, j], gc)) for j in range(cells)], axis=1)
        else:
            z = np.zeros((n, t))
            z[np.arange(n), np.minimum(t, np.maximum(1, np.rint(np.median(alpha, axis=1)))).astype(int) - 1] = 1
            f = np.stack([positive(Loess(gc[~bad]).predict((ratio[:, j] / (z @ (np.arange(1, t + 1) / 2)))[~bad], gc)) for j in range(cells)], axis=1)
            rounds, df, dz = 1, np.inf, np.inf
            while rounds <= 3 or df > 5e-6 or dz > 0.005:
                share = z.mean(axis=0)
                new_f = np.stack([positive(smoother.fit(ratio[:, j] / (z @ (np.arange(1, t + 1) / 2)))) for j in range(cells)], axis=1)
                logs = np.zeros((n, t))
                for s in range(1, t + 1):
                    mean = offset * new_f * s / 2
                    logs[:, s - 1] = (counts * np.log(mean) - mean - log_factorial).sum(axis=1) + np.log(share[s - 1] or 1e-100)
                new_z = np.exp(logs - logs.max(axis=1, keepdims=True))
                new_z /= new_z.sum(axis=1, keepdims=True)
                df, dz = np.mean((f - new_f) ** 2), np.mean((z - new_z) ** 2)
                f, z, rounds = new_f, new_z, rounds + 1
                if rounds >= 50:
                    break
        mean = offset * f * (z @ (np.arange(1, t + 1) / 2) if t > 1 else np.ones(n))[:, None]
        loglik = (counts * np.log(mean) - mean - log_factorial)[~bad].sum()
        results.append((2 * loglik - cells * (n - smoother.degrees() + (t - 1 if t > 1 else 0)) * np.log(n), f, z))
    at = int(np.argmax([r[0] for r in results]))
    return results[at][1], np.full(n, 2.0) if at == 0 else results[at][2].argmax(axis=1) + 1.0


@pytest.mark.parametrize("broadcast", [64, 0])
def test_clones_equal_a_plain_em(spark, monkeypatch, broadcast):
    monkeypatch.setattr(em, "BROADCAST_CLONES", broadcast)
    rng = np.random.default_rng(3)
    n, states = 80, [1, 2, 3, 4]
    gc = np.sort(rng.uniform(30, 60, n))
    truth = {"normal": np.full(n, 2), "gain": np.repeat([2, 3, 4, 2], n // 4), "loss": np.repeat([2, 1, 2, 3], n // 4), "flat": np.full(n, 2)}
    members = {"normal": 3, "gain": 4, "loss": 3, "flat": 2}
    rows, matrices = [], {}
    for clone, k in members.items():
        offset = rng.uniform(60, 140, (n, k))
        counts = rng.poisson(offset * truth[clone][:, None] / 2 * (1 + 0.01 * (gc[:, None] - 45)))
        ratio = counts / offset
        alpha = truth[clone][:, None] + rng.normal(0, 0.2, (n, k))
        matrices[clone] = counts, ratio, offset, alpha
        rows += [(f"{clone}{j}", clone, clone == "normal", *(m[:, j].astype(float).tolist() for m in matrices[clone])) for j in range(k)]
    cells = spark.createDataFrame(rows, "cell string, clone string, is_normal boolean, count array<double>, ratio array<double>, offset array<double>, alpha array<double>").repartition(4)
    found = {r["cell"]: (np.array(r["curve"]), np.array(r["alpha"])) for r in em.fit_clones(cells, gc, states).collect()}
    assert len(found) == len(rows)
    for clone, k in members.items():
        if clone == "normal":
            curves, copies = np.stack([Loess(gc).fit(matrices[clone][1][:, j]) for j in range(k)], axis=1), np.full(n, 2.0)
        else:
            curves, copies = plain(*matrices[clone], gc, states, 20)
        for j in range(k):
            assert np.allclose(found[f"{clone}{j}"][0], curves[:, j], rtol=1e-9) and (found[f"{clone}{j}"][1] == copies).all()
    assert (found["gain0"][1] == truth["gain"]).mean() > 0.9
