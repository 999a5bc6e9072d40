"""Demultiplexing: streams with long lists, counters, lines with many tags, and what is written."""

import time

import pytest
from pyspark.sql import functions as F

from cellcnv.operators import coverage
from cellcnv.sources import reads as source
from cellcnv.streaming.demux import DemuxCounters, demultiplex_stream, read_lines


def line(*barcodes, tag="CB:Z:"):
    return "\t".join(["r"] * 11 + [tag + b for b in barcodes])


def long_list(spark, n=1_000_000):
    return spark.range(n).select(F.concat(F.lit("B"), F.col("id").cast("string"), F.lit("-1")).alias("barcode"))


def first_listed(lines, listed):
    out = []
    for text in lines:
        tags = [t.split(":") for t in sorted(text.split()[11:])]
        found = [t[-1] for t in tags if "CB" in t and t[-1] in listed]
        out.append(found[0] if found else None)
    return out


LINES = [line("B7-1"), line("x-1"), line("x-1", "B9-1"), line("B5-1", "B3-1"), line("x-1", "y-1", "B1-1", "B2-1"), line(), line("B7-1", tag="NM:i:"), line("B4-1", tag="CB:"), line("B999999-1"), line("B1000000-1"), ""]


@pytest.mark.parametrize("broadcast", [True, False])
def test_first_listed_tag_wins(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(source, "small", lambda df: df)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = spark.createDataFrame([(k, s) for k, s in enumerate(LINES)], "k int, line string")
        found = source.with_barcode(lines, long_list(spark, 1000).unionByName(long_list(spark, 3)))
        want = first_listed(LINES, {f"B{k}-1" for k in range(1000)})
        assert [r["barcode"] for r in found.orderBy("k").collect()] == want and want.count(None) == 6
        plan = source.demultiplex(lines, long_list(spark, 1000))._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan and plan.count("split(trim") <= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_too_many_tags_are_an_error(spark):
    lines = spark.createDataFrame([(line(*(f"x{k}-1" for k in range(5))),)], "line string")
    with pytest.raises(Exception, match="more than 4 CB tags"):
        source.with_barcode(lines, long_list(spark, 10)).collect()
    assert source.with_barcode(lines, spark.createDataFrame([("x4-1",)], "barcode string"), most_tags=5).first()["barcode"] == "x4-1"


def test_stream_with_a_million_barcodes_and_counters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    parts = [LINES[:4], LINES[4:9], [line("x-1")]]
    for k, part in enumerate(parts):
        (tmp_path / "in" / f"{k}.sam").write_text("\n".join(part) + "\n")
        time.sleep(0.05)
    counters = DemuxCounters()
    spark.streams.addListener(counters)
    try:
        query = demultiplex_stream(read_lines(spark, str(tmp_path / "in"), max_files=1), long_list(spark), str(tmp_path / "out"), str(tmp_path / "state"))
        assert query.awaitTermination(120)
        for _ in range(100):  # the listener is told a moment later
            if len(counters.batches) == 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counters)
    listed = {f"B{k}-1" for k in range(1_000_000)}
    want = [first_listed(part, listed) for part in parts]
    counted = [(b.total, b.kept, b.fraction) for b in sorted(counters.batches.values(), key=lambda b: b.batch)]
    assert counted == [(len(w), len(w) - w.count(None), 1 - w.count(None) / len(w)) for w in want]
    assert (counters.total, counters.kept, counters.fraction) == (10, 6, 0.6)
    out = spark.read.text(str(tmp_path / "out")).collect()
    assert sorted((r["barcode"], r["value"]) for r in out) == sorted((b, s) for w, part in zip(want, parts) for b, s in zip(w, part) if b)
    assert {r["barcode_dir"] for r in out} == {r["barcode"][:-2] for r in out}


def test_files_are_read_and_written(spark, tmp_path):
    (tmp_path / "list.csv").write_text("barcode,n\nB1-1,5\nB2-1,6\nB1-1,7\n")
    barcodes = source.read_barcodes(spark, str(tmp_path / "list.csv"))
    assert sorted(r["barcode"] for r in barcodes.collect()) == ["B1-1", "B2-1"]
    sam = "r\t65\tchr1\t10\t50\t4M\t*\t0\t0\tACGT\t*\tCB:Z:B1-1"
    (tmp_path / "s1.dedup.sam").write_text("@HD\tVN:1\n" + sam + "\nr\t77\t*\t0\t0\t*\t*\t0\t0\tACGTA\t*\n")
    got = source.read_sam(spark, str(tmp_path / "s1.dedup.sam")).orderBy(F.desc("flag")).collect()
    assert [tuple(r[c] for c in ("cell", "chrom", "pos", "mapq", "qwidth", "flag")) for r in got] == [("s1", None, None, None, 5, 77), ("s1", "chr1", 10, 50, 4, 65)]
    kept = source.demultiplex(spark.createDataFrame([(sam,), (sam,)], "line string"), barcodes)
    source.write_demultiplexed(kept, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.text(str(tmp_path / "out")).select("value", "barcode_dir", "barcode").collect()] == [(sam, "B1", "B1-1")] * 2


@pytest.mark.parametrize(("genome", "kept"), [("hg38", ["chr22", "chrX", "chrY"]), ("mm10", ["chr1", "chr19"])])
def test_masks_of_other_genomes(spark, genome, kept):
    names = ["chr22", "chrX", "chrY", "chrM", "chrUn_1"] if genome == "hg38" else ["chr1", "chr19", "chr20", "chrM"]
    first = spark.createDataFrame([(c, "5", "9", "x") for c in names], "a string, b string, c string, d string")
    second = spark.createDataFrame([(1, "chr22", "1", "3")], "n int, a string, b string, c string")
    found = source.mask_table(genome, first, second) if genome == "hg38" else source.mask_table(genome, blacklist=first)
    want = [(c, 5, 9) for c in kept] + ([("chr22", 1, 3)] if genome == "hg38" else [])
    assert [tuple(r) for r in found.collect()] == sorted(want)


def test_small_counts_before_it_broadcasts(spark):
    plan = lambda df: coverage.small(df, 5)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(spark.range(5)) and "broadcast" not in plan(spark.range(6))
