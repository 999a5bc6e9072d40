import numpy as np
import pytest
from pyspark.sql import functions as F

from cellcnv.functions.numeric import low_quantile, signif
from cellcnv.operators import bins, calls, coverage, gini, latent, ploidy, qc, segment, views
from cellcnv.sources import reads as source
from cellcnv.streaming.demux import demultiplex_stream, read_lines


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_arguments_are_checked(spark):
    lengths = spark.createDataFrame([("chr1", 1_200_000), ("chrX", 700_000)], "chrom string, len long")
    with pytest.raises(ValueError):
        bins.genome_bins(lengths, "hg18")
    with pytest.raises(ValueError):
        bins.genome_bins(lengths, "hg19", 0)
    assert [r["end"] for r in bins.genome_bins(lengths).orderBy("bin_idx").collect()] == [500_000, 1_000_000, 1_200_000]
    assert bins.genome_bins(lengths, sex=True).count() == 5
    with pytest.raises(ValueError, match="exceed the number"):
        latent.check_factors([1, 2, 3], 2)
    with pytest.raises(ValueError):
        source.mask_table("hg18")


def test_gini_edges(spark):
    depth = spark.createDataFrame([("flat", i, 5) for i in range(10)] + [("one", i, 10 * (i == 3)) for i in range(10)] + [("none", i, 0) for i in range(10)], "cell string, bin_idx int, count long")
    found = {r["cell"]: r["gini"] for r in gini.gini(depth).collect()}
    assert found == {"flat": 0.0, "one": pytest.approx(0.9), "none": None}
    assert {r["cell"] for r in gini.classified(gini.gini(depth)).where("is_normal").collect()} == {"flat"}


def test_reads_over_edges_and_masks(spark):
    reads = spark.createDataFrame([("a", "1", 95, 50, 10, 65), ("a", "1", 10, 50, 10, 65), ("a", None, None, None, 10, 69), ("a", "1", 50, 50, 10, 65 + 1024)], "cell string, chrom string, pos long, mapq int, qwidth int, flag int")
    tiles = bins.tile(spark.createDataFrame([("chr1", 1, 250)], "chrom string, chrom_rank int, len long"), 100)
    assert [r["count"] for r in coverage.coverage(reads, tiles, 100).orderBy("bin_idx").collect()] == [2, 1, 0]
    mask = spark.createDataFrame([("chr1", 19, 30)], "chrom string, start long, end long")
    assert [r["count"] for r in coverage.coverage(reads, tiles, 100, mask).orderBy("bin_idx").collect()] == [1, 1, 0]
    metrics = qc.qc_metrics(reads).first()
    assert (metrics["total"], metrics["mapped"], metrics["non_dup"], metrics["mapq20"]) == (4, 3, 2, 2)


def test_few_bins_take_the_arithmetic_mean(spark):
    depth = spark.createDataFrame([(c, i, (i + 1) * (1 + (c == "b"))) for c in "ab" for i in range(5)], "cell string, bin_idx int, count long")
    assert {r["cell"]: r["factor"] for r in qc.size_factors(depth).collect()} == {"a": pytest.approx(2 / 3), "b": pytest.approx(4 / 3)}


def test_rounding_and_quantile(spark):
    values = spark.createDataFrame([(0.0,), (0.012345,), (12345.0,), (-2.5,)], "x double")
    assert [r[0] for r in values.select(signif(F.col("x"))).collect()] == pytest.approx([0.0, 0.0123, 12300.0, -2.5])
    many = spark.range(5000).select((F.col("id") * 7 % 5000).cast("double").alias("x"))
    assert low_quantile(many, "x") == pytest.approx(np.quantile(np.arange(5000), 0.005))


SAM = [
    "r\t65\tchr1\t10\t50\t4M\t*\t0\t0\tACGT\t*\tNM:i:0\tCB:Z:AAA-1", "r\t65\tchr1\t11\t50\t4M\t*\t0\t0\tACGT\t*\tCB:Z:ZZZ-1\tCB:Z:BBB-1",
    "r\t77\t*\t0\t0\t*\t*\t0\t0\tACGTA\t*", "r\t65\tchr1\t12\t50\t4M\t*\t0\t0\tACGT\t*\tNM:i:0\tCB:Z:QQQ-1",
]


def test_demultiplexing_batch_and_stream(spark, tmp_path):
    barcodes = spark.createDataFrame([("AAA-1",), ("BBB-1",)], "barcode string")
    lines = spark.createDataFrame([(s,) for s in SAM], "line string")
    kept = source.demultiplex(lines, barcodes)
    assert sorted((r["barcode_dir"], r["barcode"]) for r in kept.collect()) == [("AAA", "AAA-1"), ("BBB", "BBB-1")]
    assert tuple(source.demux_summary(source.with_barcode(lines, barcodes)).first()) == (4, 2, 0.5)
    parsed = source.parse_sam(lines).collect()
    assert parsed[2]["chrom"] is None and parsed[2]["pos"] is None and parsed[2]["qwidth"] == 5
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.sam").write_text("\n".join(SAM) + "\n")
    demultiplex_stream(read_lines(spark, str(tmp_path / "in")), barcodes, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    out = spark.read.text(str(tmp_path / "out"))
    assert out.count() == 2 and sorted(r["barcode"] for r in out.select("barcode").collect()) == ["AAA-1", "BBB-1"]


def planted(spark):
    """Six cells, two chromosomes of 20 bins; cells 3 to 5 have three copies on the second half of chr2."""
    rng = np.random.default_rng(8)
    tiles = bins.tile(spark.createDataFrame([("chr1", 1, 2000), ("chr2", 2, 2000)], "chrom string, chrom_rank int, len long"), 100)
    truth = {(c, b): 3 if c >= 3 and b > 30 else 2 for c in range(6) for b in range(1, 41)}
    fit = spark.createDataFrame([(f"c{c}", b, int(rng.poisson(100 * n / 2)), 100.0) for (c, b), n in truth.items()], "cell string, bin_idx int, count long, yhat double")
    return fit, tiles, truth


def test_planted_gain_is_called(spark):
    fit, tiles, truth = planted(spark)
    out = segment.segment_genome(fit, tiles)
    found = sorted((r["st_bin"], r["ed_bin"]) for r in out["segments"].collect())
    assert [b for a, e in found for b in range(a, e + 1)] == list(range(1, 41)) and {1, 21, 31} <= {a for a, _ in found}
    profile = out["profile"].collect()
    assert len(profile) == 240 and all(truth[int(r["cell"][1:]), r["bin_idx"]] == r["icn"] for r in profile)
    assert {(r["sample_name"], r["cnv_no"]) for r in out["calls"].collect()} == {("c3", 3.0), ("c4", 3.0), ("c5", 3.0)}
    views.check_shapes(out["profile"], tiles)
    with pytest.raises(ValueError):
        views.check_shapes(out["profile"], tiles.limit(3))
    with pytest.raises(ValueError):
        segment.on_chromosome(fit, tiles, "chr9")
    shown = views.heatmap(out["profile"], tiles)
    distance = {(r["cell_a"], r["cell_b"]): r["distance"] for r in views.cell_distances(shown).collect()}
    assert distance["c0", "c1"] == 0 and distance["c0", "c3"] == pytest.approx(10**0.5)
    with pytest.raises(ValueError):
        calls.copy_numbers(segment.with_positions(fit, tiles), out["segments"], "other")


def test_ploidy_grid_against_numpy(spark):
    fit, tiles, _ = planted(spark)
    ratios = ploidy.normalised_ratio(segment.with_positions(fit, tiles))
    starts = ploidy.segment_starts(ratios)
    assert (31,) in rows(starts.where("cell = 'c3'").select("bin_idx"))
    levels = ploidy.segment_levels(ratios, starts)
    errors = {(r["cell"], r["x"]): r["sos"] for r in ploidy.ploidy_errors(levels).collect()}
    level = np.array([r["level"] for r in levels.where("cell = 'c3'").orderBy("bin_idx").collect()])
    assert level[-1] == 0
    for x in (1.5, 2.0, 6.0):
        assert errors["c3", x] == pytest.approx(((level * x - np.rint(level * x)) ** 2).sum())


def test_factor_effect_is_the_product(spark):
    rng = np.random.default_rng(1)
    g, h, names = rng.normal(size=(4, 2)), rng.normal(size=(3, 2)), ["a", "b", "c"]
    rows = spark.createDataFrame([(c, b + 1) for c in names for b in range(4)], "cell string, bin_idx int")
    for r in latent.with_effect(rows, g, h, names).collect():
        assert r["gh"] == pytest.approx(g[r["bin_idx"] - 1] @ h[names.index(r["cell"])])


def test_names_of_reads_without_a_cell(spark):
    reads = spark.createDataFrame([("a", "1"), ("b", "chr2"), (None, "3"), ("a", None)], "cell string, chrom string")
    assert sorted(map(str, coverage.with_chr_names(reads).collect())) == sorted(map(str, spark.createDataFrame([("a", "chr1"), ("b", "chr2"), (None, "3"), ("a", None)], "cell string, chrom string").collect()))


def test_barcode_list_meets_lines_by_hash(spark):
    lines = spark.createDataFrame([("\t".join(["x"] * 11 + ["CB:Z:AA-1", "CB:Z:BB-1"]),), ("\t".join(["x"] * 11 + ["CB:Z:BB-1"]),), ("\t".join(["x"] * 11 + ["CB:Z:BB-1"]),)], "line string")
    barcodes = spark.range(1_000_000).select(F.concat(F.lit("B"), F.col("id").cast("string")).alias("barcode")).unionByName(spark.createDataFrame([("BB-1",)], "barcode string"))
    found = source.demultiplex(lines, barcodes)
    assert [r["barcode_dir"] for r in found.collect()] == ["BB"] * 3
    both = spark.createDataFrame([("\t".join(["x"] * 11 + ["CB:Z:BB-1", "CB:Z:B77", "CB:Z:AA-1"]),)] * 2, "line string")
    assert [r["barcode"] for r in source.demultiplex(both, barcodes).collect()] == ["B77"] * 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
