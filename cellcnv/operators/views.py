"""The tables behind the plots, and saving results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_SHOWN = 7
#: Cells and bins of a block when cells are compared.
CELLS, BINS = 512, 4096


def check_shapes(profile: DataFrame, bins: DataFrame, gini: DataFrame | None = None, annotation: DataFrame | None = None) -> None:
    """Bins, Gini coefficients and annotation must match the profile's bins and cells."""
    if profile.select("bin_idx").distinct().count() != bins.count():
        raise ValueError("profile and bins differ in their number of bins")
    cells = profile.select("cell").distinct()
    for name, table in (("gini", gini), ("annotation", annotation)):
        if table is not None and (cells.join(table, "cell", "left_anti").limit(1).count() or table.count() != cells.count()):
            raise ValueError(f"profile and {name} differ in their cells")


def heatmap(profile: DataFrame, bins: DataFrame, annotation: DataFrame | None = None) -> DataFrame:
    """cell, chrom, bin_idx, shown (whole, 0 to 7), parity of the chromosome's place, and annotation columns."""
    order = bins.groupBy("chrom").agg(F.min("bin_idx").alias("first_")).withColumn("parity", F.row_number().over(Window.orderBy("first_")) % 2).drop("first_")
    shown = F.greatest(F.lit(0.0), F.least(F.lit(float(MOST_SHOWN)), F.rint("icn"))).cast("int")
    out = profile.select("cell", "chrom", "bin_idx", shown.alias("shown")).join(F.broadcast(order), "chrom")
    return out.join(F.broadcast(annotation), "cell", "left") if annotation is not None else out


def _squared_distances(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of cells of two blocks and their squared distance over one block of bins, by matrix products.

    Bins that one of two cells lacks add nothing: each square is taken over the other cell's bins.
    """
    rows = group.sort_values("cell", ignore_index=True)
    shown, there = np.zeros((2, len(rows), BINS))
    for k, (at, values) in enumerate(zip(rows["at"], rows["shown"])):
        shown[k, at], there[k, at] = values, 1
    of_a, of_b = (np.flatnonzero(rows["block"] == rows[c].iloc[0]) for c in ("block_a", "block_b"))
    squares = shown**2
    found = squares[of_a] @ there[of_b].T + there[of_a] @ squares[of_b].T - 2 * shown[of_a] @ shown[of_b].T
    a, b = np.nonzero(of_a[:, None] < of_b[None, :] if rows["block_a"].iloc[0] == rows["block_b"].iloc[0] else there[of_a] @ there[of_b].T >= 0)
    low, high = np.minimum(of_a[a], of_b[b]), np.maximum(of_a[a], of_b[b])
    names = rows["cell"].to_numpy()
    return pd.DataFrame({"cell_a": names[low], "cell_b": names[high], "part": found[a, b]})


def cell_distances(shown: DataFrame, cells_per_block: int = CELLS) -> DataFrame:
    """cell_a < cell_b and their Euclidean distance over the bins of both.

    Pairs of cells are the result itself. Cells go to blocks and bins to blocks of BINS; each pair of blocks of cells
    meets for each block of bins, as packed rows, and gives squared distances by products of matrices.
    """
    blocks = max(1, -(-shown.select("cell").distinct().count() // cells_per_block))
    at = (F.col("bin_idx") % BINS).cast("int")
    packed = shown.groupBy("cell", F.floor(F.col("bin_idx") / BINS).alias("bins")).agg(F.collect_list(F.struct(at.alias("at"), F.col("shown").cast("double").alias("shown"))).alias("rows_"))
    block = F.pmod(F.xxhash64("cell"), F.lit(blocks))
    rows = packed.select("cell", "bins", F.col("rows_.at").alias("at"), F.col("rows_.shown").alias("shown"), block.alias("block"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    rows = rows.withColumn("block_a", F.least("block", "other")).withColumn("block_b", F.greatest("block", "other")).drop("other")
    pairs = rows.groupBy("block_a", "block_b", "bins").applyInPandas(_squared_distances, "cell_a string, cell_b string, part double")
    return pairs.groupBy("cell_a", "cell_b").agg(F.sqrt(F.sum("part")).alias("distance"))


def chromosome_borders(bins: DataFrame) -> DataFrame:
    """chrom, n_bins, total (running) and middle (rounded place of the label)."""
    sizes = bins.groupBy("chrom").agg(F.count("*").alias("n_bins"), F.min("bin_idx").alias("first_"))
    along = Window.orderBy("first_")
    out = sizes.withColumn("total", F.sum("n_bins").over(along))
    return out.select("chrom", "n_bins", "total", F.rint(F.col("total") - F.col("n_bins") + F.col("n_bins") / 2).cast("long").alias("middle"))


def save(table: DataFrame, path: str) -> None:
    """Parquet, partitioned by chromosome where the table has it."""
    table.write.mode("overwrite").partitionBy(*(c for c in ("chrom",) if c in table.columns)).parquet(path)
