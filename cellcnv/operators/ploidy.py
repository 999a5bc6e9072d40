"""Ploidy of each cell or clone from segment levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalised_ratio(fit: DataFrame) -> DataFrame:
    """fit (cell, bin_idx, count, yhat) with ratio = (count + 1) / (yhat + 1) and its log."""
    return fit.withColumn("ratio", (F.col("count") + 1) / (F.col("yhat") + 1)).withColumn("log_ratio", F.ln("ratio"))


def segment_levels(ratios: DataFrame, starts: DataFrame) -> DataFrame:
    """cell, bin_idx, level: the median ratio of the bin's segment over the cell's mean level.

    starts has cell and bin_idx of each segment's first bin. Kept from the published method: the last bin has
    level 0, and the first segment's median takes in the first bin of the second. A cell of one segment has
    level 1 throughout.
    """
    marked = ratios.select("cell", "bin_idx", "ratio").join(starts.select("cell", "bin_idx", F.lit(1).alias("start_")), ["cell", "bin_idx"], "left")
    by_cell = Window.partitionBy("cell")
    marked = marked.withColumn("seg_", F.sum(F.coalesce("start_", F.lit(0))).over(by_cell.orderBy("bin_idx")))
    marked = marked.withColumn("seg_", F.greatest("seg_", F.lit(1))).withColumn("n_seg_", F.max("seg_").over(by_cell)).withColumn("last_", F.max("bin_idx").over(by_cell))
    inner = (F.col("n_seg_") == 1) | (F.col("bin_idx") < F.col("last_"))
    first_of_second = (F.col("seg_") == 2) & (F.col("start_") == 1)
    own = F.when(inner, F.col("seg_"))
    members = marked.withColumn("of_", F.explode(F.array_compact(F.array(own, F.when(first_of_second, F.lit(1))))))
    medians = members.groupBy("cell", F.col("of_").alias("seg_")).agg(F.median("ratio").alias("median_"))
    level = marked.join(medians, ["cell", "seg_"], "left").withColumn("raw_", F.when(inner, F.col("median_")).otherwise(0.0))
    return level.select("cell", "bin_idx", (F.col("raw_") / F.avg("raw_").over(by_cell)).alias("level"))


def ploidy_grid(low: float = 1.5, high: float = 6.0, step: float = 0.05) -> Column:
    """The candidate ploidies as an array literal."""
    n = round((high - low) / step)
    return F.array(*(F.lit(round(low + i * step, 10)) for i in range(n + 1)))


def ploidy_errors(levels: DataFrame, low: float = 1.5, high: float = 6.0, clones: DataFrame | None = None) -> DataFrame:
    """sos for each cell (or clone) and candidate ploidy x: squared distance of level * x from whole numbers.

    Equal levels are counted first, so the grid multiplies segments, not bins.
    """
    key = "cell"
    runs = levels.groupBy("cell", "level").agg(F.count("*").alias("n_"))
    if clones is not None:
        key = "clone"
        runs = runs.join(F.broadcast(clones.select("cell", "clone")), "cell")
    rows = runs.select(key, "level", "n_", F.explode(ploidy_grid(low, high)).alias("x"))
    scaled = F.col("level") * F.col("x")
    return rows.groupBy(key, "x").agg(F.sum(F.col("n_") * F.pow(scaled - F.rint(scaled), 2)).alias("sos"))


def best_ploidy(errors: DataFrame) -> DataFrame:
    """The candidate with the smallest error for each cell or clone; the lowest one on ties."""
    key = errors.columns[0]
    return errors.groupBy(key).agg(F.min_by("x", F.struct("sos", "x")).alias("ploidy"))


def clone_ploidy(levels: DataFrame, clones: DataFrame, low: float = 1.5, high: float = 6.0) -> DataFrame:
    """cell, clone, ploidy: one ploidy for all cells of a clone."""
    return clones.select("cell", "clone").join(F.broadcast(best_ploidy(ploidy_errors(levels, low, high, clones))), "clone").select("cell", "clone", "ploidy")


def segment_starts(ratios: DataFrame, min_width: int = 5, seed: int = 1) -> DataFrame:
    """cell, bin_idx of each segment's first bin: outliers smoothed, then binary segmentation of each (cell, chrom).

    ratios: cell, chrom, bin_idx, log_ratio. The seed of the permutations comes from the cell and chromosome.
    """
    import zlib

    import pandas as pd

    from ..functions.kernels import cbs

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin_idx")
        first = cbs.segment(cbs.smooth_outliers(group["log_ratio"].to_numpy(float)), min_width, seed=zlib.crc32(f"{seed} {key[0]} {key[1]}".encode()))
        return pd.DataFrame({"cell": key[0], "bin_idx": group["bin_idx"].to_numpy()[first]})

    kind = dict(ratios.dtypes)["bin_idx"]
    return ratios.select("cell", "chrom", "bin_idx", "log_ratio").groupBy("cell", "chrom").applyInPandas(run, f"cell string, bin_idx {kind}")


def initialise(fit: DataFrame, low: float = 1.5, high: float = 6.0, min_width: int = 5, clones: DataFrame | None = None) -> DataFrame:
    """cell, ploidy (and clone). fit: cell, chrom, bin_idx, count, yhat."""
    from ..functions.tables import stored

    ratios = stored(normalised_ratio(fit), "ratios")
    levels = segment_levels(ratios, stored(segment_starts(ratios, min_width), "starts"))
    return clone_ploidy(levels, clones, low, high) if clones is not None else best_ploidy(ploidy_errors(levels, low, high))
