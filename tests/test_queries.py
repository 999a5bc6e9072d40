"""Registered queries against their SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["genome_bins", "bin_gc", "unmasked_reads", "gini_coefficients", "library_sizes", "ploidy_errors", "scan_statistic", "bin_profile", "demultiplexed", "parsed_sam", "demux_summary", "scan_statistic_blocks", "cell_distances", "depth", "floored_by_quantile", "qc_bins"]


def plain(value):
    if isinstance(value, float):
        return "none" if math.isnan(value) else f"{value:.6g}"
    return str(value)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(found.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    asked = db.sql(f"select {quoted} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(map(plain, (r[c] for c in columns))) for r in found.collect()) == sorted(tuple(plain(float(v)) if type(v).__name__ == "Decimal" else plain(v) for v in r) for r in asked)


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() == 10


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
