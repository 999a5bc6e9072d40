"""Copy numbers of segments, the call table and per-bin profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_COPIES = 14.0


def copy_numbers(placed: DataFrame, segments: DataFrame, mode: str = "integer") -> DataFrame:
    """cell, chrom, st, ed, cn: twice count over expectation, whole ("integer") or not ("fraction"), at most 14.

    placed: cell, chrom, pos, count, yhat.
    """
    if mode not in ("integer", "fraction"):
        raise ValueError(f"unknown mode {mode}")
    rows = placed.join(F.broadcast(segments.select("chrom", "st", "ed")), (placed["chrom"] == segments["chrom"]) & placed["pos"].between(segments["st"], segments["ed"])).drop(segments["chrom"])
    sums = rows.groupBy("cell", "chrom", "st", "ed").agg(F.sum("count").alias("y_"), F.sum("yhat").alias("l_"))
    cn = 2 * F.try_divide("y_", "l_")
    cn = F.rint(cn) if mode == "integer" else cn
    return sums.select("cell", "chrom", "st", "ed", F.least(cn, F.lit(MOST_COPIES)).alias("cn"))


def call_table(numbers: DataFrame, sizes: DataFrame) -> DataFrame:
    """sample_name, chrom, st_bin, ed_bin (global), cnv_no of segments that differ from two copies. sizes: chrom, first."""
    rows = numbers.where("cn <> 2").join(F.broadcast(sizes.select("chrom", "first")), "chrom")
    shift = F.col("first") - 1
    out = rows.select(F.col("cell").alias("sample_name"), "chrom", (F.col("st") + shift).alias("st_bin"), (F.col("ed") + shift).alias("ed_bin"), F.col("cn").alias("cnv_no"))
    return out.orderBy("st_bin", "sample_name")


def profile(placed: DataFrame, numbers: DataFrame) -> DataFrame:
    """cell, chrom, bin_idx, image_orig (log ratio within [-2, 2]), image_seg (log of half the copies; -inf for none), icn."""
    raw = F.ln(F.greatest(F.col("count").cast("double"), F.lit(0.001)) / F.col("yhat"))
    rows = placed.join(numbers, ["cell", "chrom"]).where("pos between st and ed")
    seg = F.when(F.col("cn") == 0, F.lit(float("-inf"))).otherwise(F.ln(F.col("cn") / 2))
    return rows.select("cell", "chrom", "bin_idx", F.greatest(F.lit(-2.0), F.least(F.lit(2.0), raw)).alias("image_orig"), seg.alias("image_seg"), F.col("cn").alias("icn"))
