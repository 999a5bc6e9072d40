"""Genome bins: fixed-width tiles, their order and labels, GC content and mappability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Supported genomes and their number of autosomes.
AUTOSOMES = {"hg19": 22, "hg38": 22, "mm10": 19}


def check_arguments(genome: str, resolution: float = 1) -> None:
    if genome not in AUTOSOMES:
        raise ValueError(f"unknown genome {genome}: use one of {', '.join(AUTOSOMES)}")
    if resolution <= 0:
        raise ValueError("resolution must be positive")


def karyotype(spark: SparkSession, genome: str, sex: bool = False) -> DataFrame:
    """chrom and chrom_rank of the chromosomes to keep, in karyotype order."""
    names = [*range(1, AUTOSOMES[genome] + 1), *(["X", "Y"] if sex else [])]
    return spark.createDataFrame([(f"chr{c}", i) for i, c in enumerate(names, 1)], "chrom string, chrom_rank int")


def tile(chroms: DataFrame, width) -> DataFrame:
    """chrom, chrom_rank, bin_no, start, end, bin_idx: tiles of `width` bases (a number or a column), the last one cut.

    The numbering window has no partition: it runs over the bins, of which a genome has some hundred thousand.
    """
    w = F.lit(width) if isinstance(width, int) else width
    tiles = chroms.select("chrom", "chrom_rank", "len", w.cast("long").alias("w_"), F.explode(F.sequence(F.lit(0), F.floor((F.col("len") - 1) / w))).alias("bin_no"))
    bins = tiles.select("chrom", "chrom_rank", "bin_no", (F.col("bin_no") * F.col("w_") + 1).alias("start"), F.least((F.col("bin_no") + 1) * F.col("w_"), F.col("len")).alias("end"))
    return bins.withColumn("bin_idx", F.row_number().over(Window.orderBy("chrom_rank", "bin_no")))


def genome_bins(chrom_lengths: DataFrame, genome: str = "hg19", resolution: float = 500, sex: bool = False) -> DataFrame:
    """Bins of `resolution` kilobases over the autosomes (and X, Y); chrom_lengths has chrom and len."""
    check_arguments(genome, resolution)
    return tile(chrom_lengths.join(F.broadcast(karyotype(chrom_lengths.sparkSession, genome, sex)), "chrom"), int(resolution * 1000))


def labelled(bins: DataFrame) -> DataFrame:
    return bins.withColumn("label", F.format_string("%s:%d-%d", "chrom", F.col("start").cast("long"), F.col("end").cast("long")))


def _over_bins(df: DataFrame, first, last, width) -> DataFrame:
    """A row for each bin number that [first, last] touches."""
    return df.withColumn("bin_no", F.explode(F.sequence(F.floor((first - 1) / width), F.floor((last - 1) / width))))


def gc_content(bins: DataFrame, chunks: DataFrame, width) -> DataFrame:
    """bins with gc: percent of G and C among all bases (N included), two digits; null without sequence.

    chunks (chrom, start, seq) are cut at bin edges, counted and summed per bin.
    """
    w = F.lit(width)
    last = F.col("start") + F.length("seq") - 1
    cut = _over_bins(chunks.where(F.length("seq") > 0), F.col("start"), last, w)
    low = F.greatest(F.col("start"), F.col("bin_no") * w + 1)
    high = F.least(last, (F.col("bin_no") + 1) * w)
    part = cut.select("chrom", "bin_no", F.substring("seq", (low - F.col("start") + 1).cast("int"), (high - low + 1).cast("int")).alias("part"))
    counts = part.groupBy("chrom", "bin_no").agg(F.sum(F.length(F.regexp_replace(F.upper("part"), "[^GC]", ""))).alias("gc_"), F.sum(F.length("part")).alias("all_"))
    gc = F.bround(F.try_divide(F.col("gc_") * F.lit(100.0), F.col("all_")), 2)
    return bins.join(counts, ["chrom", "bin_no"], "left").withColumn("gc", gc).drop("gc_", "all_")


def mappability(bins: DataFrame, track: DataFrame | None, width, genome: str = "hg19") -> DataFrame:
    """bins with mapp: mean score of the track weighted by overlap; 1 where nothing overlaps, and for mm10."""
    if genome == "mm10" or track is None:
        return bins.withColumn("mapp", F.lit(1.0))
    w = F.lit(width)
    rows = _over_bins(track, F.col("start"), F.col("end"), w).join(F.broadcast(bins.select("chrom", "bin_no", F.col("start").alias("s_"), F.col("end").alias("e_"))), ["chrom", "bin_no"])
    overlap = F.least("end", "e_") - F.greatest("start", "s_") + 1
    rows = rows.withColumn("o_", overlap).where("o_ > 0")
    mean = rows.groupBy("chrom", "bin_no").agg((F.sum(F.col("score") * F.col("o_")) / F.sum("o_")).alias("mapp"))
    return bins.join(mean, ["chrom", "bin_no"], "left").withColumn("mapp", F.coalesce("mapp", F.lit(1.0)))
