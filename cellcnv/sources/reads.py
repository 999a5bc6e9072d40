"""Alignment records: SAM text, sample names, barcode lists, demultiplexing, mask tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coverage import small

#: Barcode tags that a line may have; the format allows each tag once.
MOST_TAGS = 4

# The chromosomes that mask tables are kept on.
MASK_CHROMS = {
    "hg19": [f"chr{c}" for c in [*range(1, 23), "X", "Y"]],
    "hg38": [f"chr{c}" for c in [*range(1, 23), "X", "Y"]],
    "mm10": [f"chr{c}" for c in [*range(1, 20), "X", "Y"]],
}


def sample_name(path: Column) -> Column:
    """A file's base name up to its first dot."""
    return F.substring_index(F.element_at(F.split(path, "/"), -1), ".", 1)


def parse_sam(lines: DataFrame, line: str = "line") -> DataFrame:
    """SAM lines to chrom, pos, mapq, qwidth, flag, with other columns kept; header lines go. '*' and 0 are null."""
    f = F.split(F.col(line), "\t")
    at = lambda i: F.element_at(f, i)
    mapped = at(3) != "*"
    return lines.where(~F.col(line).startswith("@")).select(
        *(c for c in lines.columns if c != line),
        F.when(mapped, at(3)).alias("chrom"), F.when(mapped & (at(4) != "0"), at(4).cast("long")).alias("pos"), F.when(mapped, at(5).cast("int")).alias("mapq"),
        F.when(at(10) != "*", F.length(at(10))).alias("qwidth"), at(2).cast("int").alias("flag"),
    )


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Reads of all SAM files under a path; the cell is the file's sample name."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), sample_name(F.col("_metadata.file_path")).alias("cell"))
    return parse_sam(lines)


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """The first column of a CSV file with a header, without repeats."""
    table = spark.read.csv(path, header=True)
    return table.select(F.col(f"`{table.columns[0]}`").alias("barcode")).where("barcode is not null").distinct()


def barcode_tags(line: str, most: int = MOST_TAGS) -> Column:
    """The barcodes that a line's tags name, in order; more than `most` of them are an error.

    Tags are the fields from the 12th on, in sorted order; a tag counts if one of its colon-separated tokens is CB,
    and its last token is the barcode.
    """
    fields = F.split(F.trim(F.col(line)), r"\s+")
    tags = F.array_sort(F.slice(fields, 12, F.greatest(F.lit(0), F.size(fields) - 11)))
    tokens = F.transform(tags, lambda t: F.split(t, ":"))
    return F.transform(F.filter(tokens, lambda t: F.array_contains(t, "CB")), lambda t: F.element_at(t, -1))


def with_barcode(lines: DataFrame, barcodes: DataFrame, line: str = "line", most_tags: int = MOST_TAGS) -> DataFrame:
    """All lines with the barcode of their first listed CB tag, null where there is none. Lines may be a stream.

    The tags are made once, behind a generator, as the optimiser would copy their expression to each use. The first
    tag of every line meets the list, and of the lines still without a barcode the second, and so on: joins by hash
    and without a grouping, so the operator keeps no state. The list is broadcast if it is counted to be small enough.
    A longer one takes a shuffle for each place of a tag, in which lines that need no look-up are spread by their text.
    More than most_tags CB tags in a line are an error, so that none is left out silently.
    """
    listed = small(barcodes.select(F.col("barcode").alias("listed_")).where("listed_ IS NOT NULL").distinct())
    out = lines.withColumn("found_", F.explode(F.array(barcode_tags(line))))
    many = F.raise_error(F.lit(f"a line has more than {most_tags} CB tags"))
    out = out.withColumn("barcode", F.when(F.size("found_") > most_tags, many).cast("string"))
    for place in range(most_tags):
        tag = F.when(F.col("barcode").isNull(), F.get("found_", F.lit(place)))
        # No barcode holds a character 0.
        asked = F.coalesce(tag, F.concat(F.lit("\0"), F.xxhash64(line).cast("string")))
        out = out.withColumn("asked_", asked).join(listed, F.col("asked_") == F.col("listed_"), "left")
        out = out.withColumn("barcode", F.coalesce("barcode", "listed_")).drop("asked_", "listed_")
    return out.drop("found_")


def demultiplex(lines: DataFrame, barcodes: DataFrame, line: str = "line", most_tags: int = MOST_TAGS) -> DataFrame:
    """Lines with the barcode of their first listed CB tag and its directory, the barcode without its last two characters; lines without one are dropped."""
    kept = with_barcode(lines, barcodes, line, most_tags).where("barcode IS NOT NULL")
    return kept.withColumn("barcode_dir", F.expr("substring(barcode, 1, length(barcode) - 2)"))


def demux_summary(marked: DataFrame) -> DataFrame:
    """total, kept and their ratio, from all lines with their barcode or null, in one pass."""
    counted = marked.agg(F.count("*").alias("total"), F.count("barcode").alias("kept"))
    return counted.withColumn("fraction", F.try_divide("kept", "total"))


def write_demultiplexed(kept: DataFrame, path: str, salts: int = 8, max_records: int = 5_000_000, line: str = "line") -> None:
    """One directory per barcode; deep barcodes are spread over `salts` tasks."""
    spread = kept.withColumn("salt_", F.pmod(F.xxhash64(line), F.lit(salts))).repartition("barcode", "salt_").drop("salt_")
    spread.select("barcode_dir", "barcode", line).write.partitionBy("barcode_dir", "barcode").option("maxRecordsPerFile", max_records).text(path)


def mask_table(genome: str, duplications: DataFrame | None = None, gaps: DataFrame | None = None, blacklist: DataFrame | None = None) -> DataFrame:
    """chrom, start, end of the regions to mask, from tables without headers, sorted.

    Human genomes: columns 1 to 3 of segmental duplications and 2 to 4 of gaps. Mouse: columns 1 to 3 of a blacklist.
    """
    if genome not in MASK_CHROMS:
        raise ValueError(f"unknown genome {genome}")

    def taken(table: DataFrame, first: int) -> DataFrame:
        c = table.columns[first : first + 3]
        return table.select(F.col(c[0]).alias("chrom"), F.col(c[1]).cast("long").alias("start"), F.col(c[2]).cast("long").alias("end"))

    parts = [taken(blacklist, 0)] if genome == "mm10" else [taken(duplications, 0), taken(gaps, 1)]
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.where(F.col("chrom").isin(MASK_CHROMS[genome])).orderBy("chrom", "start", "end")
