"""Quality control of cells and bins, size factors and library sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import median_and_mad
from ..functions.tables import stored

#: With this many bins without a zero or fewer, size factors take the arithmetic mean.
FEW_BINS = 10


def qc_metrics(reads: DataFrame) -> DataFrame:
    """Eight metrics of each cell, over all its records."""
    plain = F.col("flag") < 1024
    total = F.count("*")
    share = lambda n: F.bround(n / total, 3)
    mapped = F.count("chrom")
    non_dup = F.count_if(F.col("chrom").isNotNull() & plain)
    mapq20 = F.count_if(F.coalesce(plain & (F.col("mapq") >= 20), F.lit(False)))
    return reads.groupBy("cell").agg(
        F.rint(F.avg("qwidth")).alias("readlength"), total.alias("total"), mapped.alias("mapped"), share(mapped).alias("mapped_prop"),
        non_dup.alias("non_dup"), share(non_dup).alias("non_dup_prop"), mapq20.alias("mapq20"), share(mapq20).alias("mapq20_prop"),
    )


def good_cells(depth: DataFrame, metrics: DataFrame, cov_thresh: float = 0, min_count: float = 20, mapq20_thresh: float = 0.3) -> DataFrame:
    """cell of those above the total and mean depth and the share of well mapped reads."""
    sums = depth.groupBy("cell").agg(F.sum("count").alias("sum_"), F.avg("count").alias("mean_"))
    return sums.join(metrics.select("cell", "mapq20_prop"), "cell").where((F.col("sum_") > cov_thresh) & (F.col("mean_") > min_count) & (F.col("mapq20_prop") >= mapq20_thresh)).select("cell")


def good_bins(bins: DataFrame, gc_low: float = 20, gc_high: float = 80, mapp_thresh: float = 0.9) -> DataFrame:
    """Bins with GC in range (edges in) and enough mappability; a null GC is out of range."""
    return bins.where(F.col("gc").between(gc_low, gc_high) & (F.col("mapp") >= mapp_thresh))


def size_factors(depth: DataFrame) -> DataFrame:
    """cell, factor: median over bins of count to the bin's mean over cells.

    Geometric means over bins without a zero; with at most FEW_BINS of them, arithmetic means over all bins, of
    which those with a mean of zero count nowhere.
    """
    positive = F.when(F.col("count") > 0, F.col("count"))
    per_bin = depth.groupBy("bin_idx").agg(F.min("count").alias("low_"), F.exp(F.avg(F.ln(positive))).alias("geometric_"), F.avg("count").alias("mean_"))
    few = per_bin.where("low_ > 0").limit(FEW_BINS + 1).count() <= FEW_BINS
    per_bin = per_bin.select("bin_idx", F.nullif("mean_", F.lit(0.0)).alias("pseudo_")) if few else per_bin.where("low_ > 0").select("bin_idx", F.col("geometric_").alias("pseudo_"))
    ratio = depth.join(F.broadcast(per_bin), "bin_idx").select("cell", (F.col("count") / F.col("pseudo_")).alias("ratio_"))
    return ratio.groupBy("cell").agg(F.median("ratio_").alias("factor"))


def library_sizes(depth: DataFrame) -> DataFrame:
    """cell, lib_size: the size factor over their median, times the median of the cells' totals, rounded."""
    factors = size_factors(depth)
    totals = depth.groupBy("cell").agg(F.sum("count").alias("total_"))
    centre = factors.agg(F.median("factor").alias("mf_")).crossJoin(totals.agg(F.median("total_").alias("mt_")))
    return factors.crossJoin(F.broadcast(centre)).select("cell", F.rint(F.col("factor") / F.col("mf_") * F.col("mt_")).alias("lib_size"))


def depth_outliers(depth: DataFrame, factors: DataFrame, n_mad: float = 3) -> DataFrame:
    """bin_idx of bins whose summed scaled depth is within n_mad deviations of the median, edges in."""
    scaled = depth.join(F.broadcast(factors), "cell").groupBy("bin_idx").agg(F.sum(F.col("count") / F.col("factor")).alias("sum_"))
    limits = median_and_mad(scaled, "sum_")
    return scaled.crossJoin(F.broadcast(limits)).where(F.abs(F.col("sum_") - F.col("median")) <= n_mad * F.col("mad")).select("bin_idx")


def check_inputs(depth: DataFrame, bins: DataFrame, metrics: DataFrame) -> None:
    """Depth must hold exactly the bins and cells of the other tables."""
    for name, column, other in (("bins", "bin_idx", bins), ("metrics", "cell", metrics)):
        here, there = depth.select(column).distinct(), other.select(column).distinct()
        if here.join(there, column, "left_anti").limit(1).count() or there.join(here, column, "left_anti").limit(1).count():
            raise ValueError(f"depth and {name} don't hold the same {column} values")


def perform_qc(
    depth: DataFrame, bins: DataFrame, metrics: DataFrame, cov_thresh: float = 0, min_count: float = 20, mapq20_thresh: float = 0.3,
    mapp_thresh: float = 0.9, gc_low: float = 20, gc_high: float = 80, n_mad: float = 3,
) -> dict[str, DataFrame]:
    """Cell filter, bin filter, cells without a size factor, depth outliers, in this order.

    Returns depth (bins numbered anew), bins, cells, metrics and removed (step, n).
    """
    check_inputs(depth, bins, metrics)
    cells = good_cells(depth, metrics, cov_thresh, min_count, mapq20_thresh)
    cells = stored(cells, "cells")
    kept_bins = stored(good_bins(bins, gc_low, gc_high, mapp_thresh), "bins")
    part = stored(depth.join(F.broadcast(cells), "cell", "left_semi").join(F.broadcast(kept_bins.select("bin_idx")), "bin_idx", "left_semi"), "part")
    factors = size_factors(part)
    factors = stored(factors.where("factor > 0"), "factors")
    part2 = part.join(F.broadcast(factors.select("cell")), "cell", "left_semi")
    inside = depth_outliers(part2, factors, n_mad)
    final_bins = kept_bins.join(inside, "bin_idx", "left_semi").withColumn("new_", F.row_number().over(Window.orderBy("bin_idx")))
    final_bins = stored(final_bins, "final-bins")
    out = part2.join(F.broadcast(final_bins.select("bin_idx", "new_")), "bin_idx").select("cell", F.col("new_").alias("bin_idx"), "count")
    one = lambda name, a, b: a.agg(F.count("*").alias("a_")).crossJoin(b.agg(F.count("*").alias("b_"))).select(F.lit(name).alias("step"), (F.col("a_") - F.col("b_")).alias("n"))
    removed = (
        one("cells_depth_or_mapq", metrics, cells).unionByName(one("bins_gc_or_mapp", bins, kept_bins)).unionByName(one("cells_size_factor", cells, factors)).unionByName(one("bins_depth_outlier", kept_bins, final_bins))
    )
    return {
        "depth": out, "bins": final_bins.drop("bin_idx").withColumnRenamed("new_", "bin_idx"), "cells": factors.select("cell"),
        "metrics": metrics.join(F.broadcast(factors.select("cell")), "cell", "left_semi"), "removed": removed,
    }
