"""First normalisation, without latent factors: a GC curve per cell and a bias per bin, in turns.

`depth` is cell, bin_idx, count; gc is known per bin and goes to the tasks (one number a bin). Each round maps
cells to curves, floors them by a global quantile and takes medians per bin; only differences come back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels.loess import positive
from ..functions.kernels.spline import SmoothingSpline
from ..functions.numeric import low_quantile, signif
from ..functions.tables import passing, stored
from . import qc

MOST_ROUNDS = 10
BIAS_CHANGE, LATE_ROUND, LATE_CHANGE = 1e-4, 5, 1.0


def packed(depth: DataFrame, *values: str) -> DataFrame:
    """One row per cell: its values as arrays in bin order."""
    rows = depth.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("bin_idx", *values))).alias("rows_"))
    return rows.select("cell", *(F.col(f"rows_.{v}").alias(v) for v in values))


def gc_of(bins: DataFrame) -> np.ndarray:
    """GC of the bins in order; as many numbers as the genome has bins."""
    return bins.orderBy("bin_idx").select("gc").toPandas()["gc"].to_numpy(float)


def long_form(curves: DataFrame, *values: str) -> DataFrame:
    """cell, bin_idx and values from one row of arrays per cell."""
    rows = curves.select("cell", F.posexplode(F.arrays_zip(*values)).alias("at_", "v_"))
    return rows.select("cell", (F.col("at_") + 1).alias("bin_idx"), *(F.col(f"v_.{v}").alias(v) for v in values))


def bin_bias(ratios: DataFrame) -> DataFrame:
    """bin_idx, beta: median ratio of the given cells; what isn't positive becomes the smallest positive one."""
    medians = ratios.groupBy("bin_idx").agg(F.median("ratio").alias("m_"))
    least = medians.where("m_ > 0").agg(F.min("m_").alias("least_"))
    return medians.crossJoin(F.broadcast(least)).select("bin_idx", F.when(F.col("m_") > 0, F.col("m_")).otherwise(F.col("least_")).alias("beta"))


def smooth_curves(cells: DataFrame, spline: SmoothingSpline, beta: np.ndarray) -> DataFrame:
    """cell, curve from counts, lib_size by one smoothing spline per cell."""

    def run(batches):
        for b in batches:
            curves = [positive(spline.fit(np.asarray(c, float) / n / beta)).tolist() for c, n in zip(b["count"], b["lib_size"])]
            yield pd.DataFrame({"cell": b["cell"], "curve": curves})

    return cells.mapInPandas(run, "cell string, curve array<double>")


def should_stop(round_no: int, bias_change: float) -> bool:
    """After an accepted round: the bias has settled, or swings late."""
    return bias_change < BIAS_CHANGE or (round_no > LATE_ROUND and bias_change > LATE_CHANGE)


def normalise_first(depth: DataFrame, bins: DataFrame, normal_cells: DataFrame) -> DataFrame:
    """cell, bin_idx, count, yhat, fgc, beta, lib_size; fgc and beta at three significant digits.

    The bins must be numbered 1.. without gaps. The round with the smallest change of the curves wins; a round
    whose curves change more than the best so far ends the search and is left out.
    """
    with passing(depth.sparkSession) as kept:
        return kept(_first_pass(depth, bins, normal_cells), "first-pass")


def _first_pass(depth: DataFrame, bins: DataFrame, normal_cells: DataFrame) -> DataFrame:
    gc = gc_of(bins)
    spline, beta = SmoothingSpline(gc), np.ones(len(gc))
    depth = stored(depth.select("cell", "bin_idx", "count"), "depth")
    flat = stored(depth.join(F.broadcast(qc.library_sizes(depth)), "cell"), "flat")
    cells = stored(packed(flat, "count", "lib_size").withColumn("lib_size", F.col("lib_size")[0]), "cells")
    normal = F.broadcast(stored(normal_cells.select("cell"), "normal"))
    before, best, least = None, None, np.inf
    for round_no in range(1, MOST_ROUNDS + 1):
        curves = stored(long_form(smooth_curves(cells, spline, beta), "curve"), "curves")
        floor = low_quantile(curves, "curve")
        curves = curves.withColumn("curve", F.greatest("curve", F.lit(floor)))
        rows = flat.join(curves, ["cell", "bin_idx"])
        ratios = rows.join(normal, "cell", "left_semi").select("bin_idx", (F.col("count") / (F.col("curve") * F.col("lib_size"))).alias("ratio"))
        new = bin_bias(ratios).orderBy("bin_idx").toPandas()["beta"].to_numpy(float)
        bias_change = float(np.mean((new - beta) ** 2))
        if before is None:
            change = curves.agg(F.avg(F.pow("curve", F.lit(2)))).first()[0]
        else:
            change = curves.join(before.withColumnRenamed("curve", "old_"), ["cell", "bin_idx"]).agg(F.avg(F.pow(F.col("curve") - F.col("old_"), 2))).first()[0]
        if change > least:
            break
        least, best, beta, before = change, (curves, new), new, curves
        if should_stop(round_no, bias_change):
            break
    curves, beta = best
    values = depth.sparkSession.createDataFrame([(i + 1, float(v)) for i, v in enumerate(beta)], "bin_idx int, beta double")
    rows = flat.join(curves, ["cell", "bin_idx"]).join(F.broadcast(values), "bin_idx")
    yhat = F.greatest(F.rint(F.col("curve") * F.col("lib_size") * F.col("beta")), F.lit(1.0))
    return rows.select("cell", "bin_idx", "count", yhat.alias("yhat"), signif(F.col("curve")).alias("fgc"), signif(F.col("beta")).alias("beta"), "lib_size")
