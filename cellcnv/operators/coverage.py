"""From reads to counts per cell and bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import stored

#: Mask lists of up to this many rows are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def paired_end(flag: Column) -> Column:
    """Paired and first mate; not a duplicate, unmapped or failing quality control."""
    return flag.bitwiseAND(0x1 | 0x40 | 0x400 | 0x4 | 0x200) == 0x1 | 0x40


def single_end(flag: Column) -> Column:
    return flag.bitwiseAND(0x1 | 0x400 | 0x4 | 0x200) == 0


def usable(mapq: int = 40, layout: str = "paired") -> Column:
    return (paired_end(F.col("flag")) if layout == "paired" else single_end(F.col("flag"))) & (F.col("mapq") >= mapq)


def filtered(reads: DataFrame, mapq: int = 40, layout: str = "paired") -> DataFrame:
    return reads.where(usable(mapq, layout))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a table that is counted to be small enough; else the table as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_chr_names(reads: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Prefix chr to the chromosome names of cells in which no name has it; reads without a cell stay as they are.

    named: cell and named_, whether a name has it, where that is known already.
    """
    if named is None:
        named = stored(reads.groupBy("cell").agg(F.max(F.col("chrom").contains("chr")).alias("named_")), "names")
    plain = F.col("named_").isNotNull() & ~F.col("named_")
    return reads.join(small(named), "cell", "left").withColumn("chrom", F.when(plain, F.concat(F.lit("chr"), "chrom")).otherwise(F.col("chrom"))).drop("named_")


def unmasked(reads: DataFrame, mask: DataFrame, bucket: int = 100_000, max_width: int | None = None) -> DataFrame:
    """Reads that overlap no mask interval; a read covers [pos, pos + qwidth - 1].

    A read keeps one row and one bucket, that of its start; the mask's rows are repeated for each bucket in which
    a read that overlaps them can start, so the anti-join has an equality to hash on.
    """
    widest = max_width or reads.agg(F.max("qwidth")).first()[0] or 1
    m = mask.select("chrom", F.col("start").alias("m_start"), F.col("end").alias("m_end"))
    m = m.withColumn("bucket_", F.explode(F.sequence(F.floor((F.col("m_start") - widest + 1) / bucket), F.floor(F.col("m_end") / bucket)))).withColumnRenamed("chrom", "m_chrom")
    r = reads.withColumn("bucket_", F.floor(F.col("pos") / bucket))
    m = small(m)
    hit = (r["chrom"] == m["m_chrom"]) & (r["bucket_"] == m["bucket_"]) & (r["pos"] <= m["m_end"]) & (r["pos"] + r["qwidth"] - 1 >= m["m_start"])
    return r.join(m, hit, "left_anti").drop("bucket_")


def counts(reads: DataFrame, bins: DataFrame, width) -> DataFrame:
    """cell, bin_idx, count: reads that touch each bin; a read over an edge counts in both. Bins without reads are absent."""
    last = F.floor((F.col("pos") + F.col("qwidth") - 2) / F.lit(width))
    touched = reads.select("cell", "chrom", F.explode(F.sequence(F.floor((F.col("pos") - 1) / F.lit(width)), last)).alias("bin_no"))
    seen = touched.groupBy("cell", "chrom", "bin_no").agg(F.count("*").alias("count"))
    return seen.join(F.broadcast(bins.select("chrom", "bin_no", "bin_idx")), ["chrom", "bin_no"]).select("cell", "bin_idx", "count")


def dense(cells: DataFrame, bins: DataFrame, sparse: DataFrame) -> DataFrame:
    """cell, bin_idx, count with zeros for pairs that have no reads. The result has cells x bins rows by definition."""
    grid = cells.select("cell").distinct().crossJoin(F.broadcast(bins.select("bin_idx")))
    return grid.join(sparse, ["cell", "bin_idx"], "left").select("cell", "bin_idx", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def coverage(reads: DataFrame, bins: DataFrame, width, mask: DataFrame | None = None, mapq: int = 40, layout: str = "paired") -> DataFrame:
    """Dense depth of every cell that has reads at all.

    One aggregate over the reads gives the cells, how they name chromosomes and the widest read; a second pass counts.
    """
    keep = usable(mapq, layout)
    facts = reads.groupBy("cell").agg(F.max(F.when(keep, F.col("chrom").contains("chr"))).alias("named_"), F.max(F.when(keep, F.col("qwidth"))).alias("widest_"))
    facts = stored(facts, "cells")
    kept = with_chr_names(reads.where(keep), facts.select("cell", "named_"))
    if mask is not None:
        kept = unmasked(kept, mask, max_width=facts.agg(F.max("widest_")).first()[0] or 1)
    return dense(facts, bins, counts(kept, bins, width))
