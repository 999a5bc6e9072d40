"""Copy states and GC curves by expectation-maximisation: per cell, or shared by the cells of a clone.

Rows are packed per cell: count, ratio, offset and alpha as arrays in bin order. A cell is one task's small
matter. A clone may hold most cells, so its rounds are Spark jobs: cells map to log densities, which are summed
per bin over cells; the clone's states (bins x T) are a table that each round replaces.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.kernels import em
from ..functions.kernels.loess import Loess
from ..functions.kernels.poisson import log_density, log_factorials
from ..functions.tables import passing, stored

CURVES = "cell string, curve array<double>, alpha array<double>"
DIAGNOSTICS = "cell string, t int, loglik double, bic double, best boolean, curve array<double>, state array<int>, share array<double>"


def _arrays(row, *names) -> list[np.ndarray]:
    return [np.asarray(getattr(row, n), float) for n in names]


def initial_alpha(cells: DataFrame, gc: np.ndarray) -> DataFrame:
    """Adds alpha = 2 ratio / (smooth / (ploidy / 2)). cells: cell, ratio, ploidy and more."""
    smoother = Loess(gc)

    def run(batches):
        for b in batches:
            alpha = []
            for row in b.itertuples(index=False):
                (ratio,) = _arrays(row, "ratio")
                alpha.append((ratio / (smoother.fit(ratio) / (row.ploidy / 2)) * 2).tolist())
            b["alpha"] = alpha
            yield b

    schema = ", ".join(f"{n} {t}" for n, t in cells.dtypes if n != "alpha") + ", alpha array<double>"
    return cells.drop("alpha").mapInPandas(run, schema)


def fit_cells(cells: DataFrame, gc: np.ndarray, states: list[int], min_count: float = 20) -> DataFrame:
    """cell, curve, alpha. cells: cell, is_normal, count, ratio, offset, alpha. Normal cells have two copies."""
    smoother = Loess(gc)
    degrees = smoother.degrees()

    def run(batches):
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                counts, ratio, offset, alpha = _arrays(row, "count", "ratio", "offset", "alpha")
                if row.is_normal:
                    out.append((row.cell, smoother.fit(ratio).tolist(), [2.0] * len(ratio)))
                else:
                    best, copy = em.winner(em.fit_cell(counts, ratio, offset, alpha, gc, smoother, degrees, states, min_count))
                    out.append((row.cell, best["curve"].tolist(), copy.tolist()))
            yield pd.DataFrame(out, columns=["cell", "curve", "alpha"])

    return cells.mapInPandas(run, CURVES)


def diagnostics(cells: DataFrame, gc: np.ndarray, states: list[int], min_count: float = 20) -> DataFrame:
    """Scores, curve and rounded states of each cell and number of states; normal cells with one state only."""
    smoother = Loess(gc)
    degrees = smoother.degrees()

    def run(batches):
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                counts, ratio, offset, alpha = _arrays(row, "count", "ratio", "offset", "alpha")
                fits = em.fit_cell(counts, ratio, offset, alpha, gc, smoother, degrees, [1] if row.is_normal else states, min_count)
                best = em.winner(fits)[0]["t"]
                out += [(row.cell, f["t"], f["loglik"], f["bic"], f["t"] == best, f["curve"].tolist(), (f["z"].argmax(axis=1) + 1).tolist(), f["share"].tolist()) for f in fits]
            yield pd.DataFrame(out, columns=["cell", "t", "loglik", "bic", "best", "curve", "state", "share"])

    return cells.mapInPandas(run, DIAGNOSTICS)


def curve_points(found: DataFrame, cells: DataFrame, bins: DataFrame) -> DataFrame:
    """cell, t, bin_idx, gc, ratio, fitted (curve times half the state), state: what the diagnostic plot draws."""
    rows = found.join(cells.select("cell", "ratio"), "cell").select("cell", "t", F.posexplode(F.arrays_zip("ratio", "curve", "state")).alias("at_", "v_"))
    rows = rows.select("cell", "t", (F.col("at_") + 1).alias("bin_idx"), F.col("v_.ratio").alias("ratio"), (F.col("v_.curve") * F.col("v_.state") / 2).alias("fitted"), F.col("v_.state").alias("state"))
    return rows.join(F.broadcast(bins.select("bin_idx", "gc")), "bin_idx")


def normal_clones(cells: DataFrame) -> DataFrame:
    """clone of those whose members are exactly the normal cells."""
    mixed = cells.groupBy("clone").agg(F.min(F.col("is_normal").cast("int")).alias("all_"), F.count("*").alias("n_"))
    total = cells.agg(F.count_if("is_normal").alias("total_"))
    return mixed.crossJoin(F.broadcast(total)).where("all_ = 1 and n_ = total_").select("clone")


#: Clones whose states are broadcast at most (a row each, of a genome's bins); those of more meet the cells by a shuffle.
BROADCAST_CLONES = 64
#: Sums of (clone, number of states) that a task holds before it passes them on.
MOST_SUMS = 256


def _softmax(logs: Column) -> Column:
    shifted = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda total, y: total + y))


def _packed_states(states: DataFrame) -> DataFrame:
    """One row per clone: for each number of states z and the z before as flat arrays in bin order."""
    flat = lambda c: F.flatten(F.transform("rows_", lambda r: r[c])).alias(c)
    rows = states.groupBy("clone", "t").agg(F.array_sort(F.collect_list(F.struct("at", "z", "before"))).alias("rows_"))
    return rows.select("clone", F.struct("t", flat("z"), flat("before")).alias("fit_")).groupBy("clone").agg(F.collect_list("fit_").alias("fits"))


class _CellFit:
    """One cell in one of its clone's fits: its curve follows from the states before the last expectation step."""

    def __init__(self, row, smoother: Loess, gc: np.ndarray):
        self.counts, self.ratio, self.offset = _arrays(row, "count", "ratio", "offset")
        self.keep, self.smoother, self.gc = np.asarray(row.keep, bool), smoother, gc
        self.fits = {f["t"]: self._unpacked(f) for f in (row.fits if row.fits is not None else ())}
        self.factorials = log_factorials(self.counts)

    @staticmethod
    def _unpacked(f) -> tuple[np.ndarray, np.ndarray | None]:
        z, before = (None if f[c] is None else np.asarray(f[c], float).reshape(-1, f["t"]) for c in ("z", "before"))
        return z, before

    def last_curve(self, t: int) -> np.ndarray:
        """The curve of the last maximisation step; before any, the smooth from the kept bins."""
        z, before = self.fits.get(t, (None, None))
        return em.curve(self.ratio, self.smoother, before) if before is not None else em.start_curve(self.ratio, self.gc, self.keep, z)


def fit_clones(cells: DataFrame, gc: np.ndarray, states: list[int], min_count: float = 20) -> DataFrame:
    """cell, curve, alpha with states shared by all cells of a clone. cells: as for fit_cells, and clone.

    The states are a table (clone, t, at, z). In each round the cells map to log densities, which tasks sum over their
    cells and Spark over tasks; one job writes the new states with what decides whether their (clone, t) goes on. Only
    the number of those that go on comes to the driver, observed as the table is written.
    """
    with passing(cells.sparkSession) as kept:
        return kept(_fit_clones(cells, gc, states, min_count), "clone-fits")


def _fit_clones(cells: DataFrame, gc: np.ndarray, states: list[int], min_count: float) -> DataFrame:
    smoother, n = Loess(gc), len(gc)
    degrees = smoother.degrees()
    normal = normal_clones(cells)
    others = stored(cells.join(normal, "clone", "left_anti"), "clones")

    def outliers(batches):
        for b in batches:
            for clone, part in b.groupby("clone"):
                bad = sum(em.outlier_bins(np.asarray(r, float), np.asarray(c, float), smoother, min_count).astype(int) for r, c in zip(part["ratio"], part["count"]))
                yield pd.DataFrame({"clone": clone, "at": np.arange(n), "bad": bad})

    kept = others.select("clone", "count", "ratio").mapInPandas(outliers, "clone string, at int, bad long").groupBy("clone", "at").agg((F.sum("bad") == 0).alias("keep"))
    middle = others.select("clone", F.posexplode("alpha").alias("at", "a_")).groupBy("clone", "at").agg(F.median("a_").alias("alpha"))
    base = stored(kept.join(middle, ["clone", "at"]), "kept")
    keep = base.groupBy("clone").agg(F.array_sort(F.collect_list(F.struct("at", "keep"))).alias("keep_")).select("clone", F.col("keep_.keep").alias("keep"))
    keep = stored(keep, "keep")
    sized = F.broadcast if keep.count() <= BROADCAST_CLONES else lambda df: df
    several = [t for t in states if t > 1]
    start = base.select("clone", "at", "alpha", F.explode(F.array(*map(F.lit, several)).cast("array<int>")).alias("t"))
    state = F.least(F.col("t"), F.greatest(F.lit(1), F.rint("alpha").cast("int")))
    one_hot = F.transform(F.sequence(F.lit(1), F.col("t")), lambda s: (s == state).cast("double"))
    of_fit, width = Window.partitionBy("clone", "t"), max([1, *several])
    share = F.slice(F.array(*(F.avg(F.get("z", F.lit(j))).over(of_fit) for j in range(width))), 1, F.col("t")).alias("share")
    begun = start.select("clone", "t", "at", one_hot.alias("z"), F.lit(None).cast("array<double>").alias("before"))
    going = stored(begun.select("*", share), "states")
    parts_done, rounds, active = [], 0, bool(several) and not going.isEmpty()

    def expect(batches):
        sums: dict = {}

        def passed_on():
            for (clone, t), (logs, change, seen) in sums.items():
                once = np.arange(n) == 0
                yield pd.DataFrame({"clone": clone, "t": t, "at": np.arange(n), "logs": list(logs), "change": once * change, "cells": once * seen})
            sums.clear()

        for b in batches:
            for row in b.itertuples(index=False):
                one = _CellFit(row, smoother, gc)
                for t, (z, _) in one.fits.items():
                    f = em.curve(one.ratio, smoother, z)
                    change = float(np.mean((f - one.last_curve(t)) ** 2))
                    logs = em.state_log_densities(one.counts, one.factorials, one.offset * f, t)
                    before = sums.get((row.clone, t), (0.0, 0.0, 0))
                    sums[row.clone, t] = before[0] + logs, before[1] + change, before[2] + 1
                if len(sums) > MOST_SUMS:
                    yield from passed_on()
        yield from passed_on()

    while active:
        wide = others.select("clone", "count", "ratio", "offset").join(sized(_packed_states(going).join(keep, "clone")), "clone")
        parts = wide.mapInPandas(expect, "clone string, t int, at int, logs array<double>, change double, cells long")
        logs = F.slice(F.array(*(F.sum(F.get("logs", F.lit(j))) for j in range(width))), 1, F.col("t")).alias("logs")
        sums = parts.groupBy("clone", "t", "at").agg(logs, F.sum("change").alias("change"), F.sum("cells").alias("cells"))
        new = sums.join(going, ["clone", "t", "at"])
        new = new.withColumn("new", _softmax(F.zip_with("logs", "share", lambda x, p: x + F.ln(F.when(p == 0, F.lit(1e-100)).otherwise(p)))))
        moved = F.aggregate(F.zip_with("new", "z", lambda x, y: F.pow(x - y, F.lit(2.0))), F.lit(0.0), lambda total, x: total + x)
        new = new.select("clone", "t", "at", F.col("new").alias("z"), F.col("z").alias("before"), moved.alias("moved"), "change", "cells")
        rounds += 1
        state_change = F.sum("moved").over(of_fit) / (F.count("*").over(of_fit) * F.col("t"))
        curve_change = F.sum("change").over(of_fit) / F.sum("cells").over(of_fit)
        on = F.lit(rounds < em.MOST_ROUNDS) & (F.lit(rounds < em.LEAST_ROUNDS) | (curve_change > em.CURVE_CHANGE) | (state_change > em.STATE_CHANGE))
        left = Observation()
        new = new.select("clone", "t", "at", "z", "before", share, on.alias("on_")).observe(left, F.count_if("on_").alias("rows"))
        new = stored(new, "round")
        parts_done.append(new.where("NOT on_"))
        going, active = new.where("on_").drop("on_"), left.get["rows"] > 0

    done = begun.limit(0)
    for part in parts_done:
        done = done.unionByName(part.drop("on_", "share"))
    found = stored(done, "fits")

    def scored(batches):
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                one = _CellFit(row, smoother, gc)
                for place, t in enumerate(states):
                    mean = one.offset * one.last_curve(t) * (em.copies(one.fits[t][0]) if t > 1 else 1.0)
                    loglik = float(log_density(one.counts, mean, one.factorials)[one.keep].sum())
                    out.append((row.clone, place, loglik, float(em.score(loglik, n, degrees, t))))
            yield pd.DataFrame(out, columns=["clone", "place", "loglik", "bic"])

    everything = sized(stored(keep.join(_packed_states(found), "clone", "left"), "packed"))
    scores = others.select("clone", "count", "ratio", "offset").join(everything, "clone").mapInPandas(scored, "clone string, place int, loglik double, bic double")
    best = scores.groupBy("clone", "place").agg(F.sum("bic").alias("bic")).groupBy("clone").agg(F.max_by("place", F.struct("bic", -F.col("place"))).alias("best"))

    def chosen(batches):
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                if row.best < 0:
                    (ratio,) = _arrays(row, "ratio")
                    out.append((row.cell, smoother.fit(ratio).tolist(), [2.0] * n))
                    continue
                one, t = _CellFit(row, smoother, gc), states[row.best]
                copy = np.full(n, 2.0) if row.best == 0 else one.fits[t][0].argmax(axis=1) + 1.0
                out.append((row.cell, one.last_curve(t).tolist(), copy.tolist()))
            yield pd.DataFrame(out, columns=["cell", "curve", "alpha"])

    wide = cells.select("cell", "clone", "count", "ratio", "offset").join(sized(stored(best, "best")), "clone", "left").join(everything, "clone", "left")
    return wide.withColumn("best", F.coalesce("best", F.lit(-1))).mapInPandas(chosen, CURVES)
