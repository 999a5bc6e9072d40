"""Distances of cells against numpy, and saving."""

import numpy as np
import pytest

from cellcnv.operators import views


@pytest.mark.parametrize("block", [512, 3])
def test_distances_equal_numpy(spark, monkeypatch, block):
    rng = np.random.default_rng(1)
    bins = rng.permutation(9000)[:60]  # over three blocks of bins
    values = rng.integers(0, 8, (11, 60)).astype(float)
    lost = rng.random((11, 60)) < 0.1
    rows = [(f"c{c:02d}", int(b), float(values[c, k])) for c in range(11) for k, b in enumerate(bins) if not lost[c, k]]
    found = views.cell_distances(spark.createDataFrame(rows, "cell string, bin_idx int, shown double"), block).collect()
    assert len(found) == 55 and all(r["cell_a"] < r["cell_b"] for r in found)
    for r in found:
        a, b = int(r["cell_a"][1:]), int(r["cell_b"][1:])
        both = ~lost[a] & ~lost[b]
        assert r["distance"] == pytest.approx(np.linalg.norm(values[a][both] - values[b][both]))
    assert views.cell_distances(spark.createDataFrame([], "cell string, bin_idx int, shown double")).count() == 0


def test_tables_are_saved_by_chromosome(spark, tmp_path):
    table = spark.createDataFrame([("chr1", "a", 1), ("chr2", "a", 2)], "chrom string, cell string, icn int")
    for _ in range(2):
        views.save(table, str(tmp_path / "profile"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "profile")).select("chrom", "cell", "icn").collect())) == [("chr1", "a", 1), ("chr2", "a", 2)]
    assert {p.name for p in (tmp_path / "profile").glob("chrom=*")} == {"chrom=chr1", "chrom=chr2"}
    views.save(table.select("cell"), str(tmp_path / "cells"))
    assert spark.read.parquet(str(tmp_path / "cells")).count() == 2
