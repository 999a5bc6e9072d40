"""Gini coefficient of each cell, and the cells that it calls normal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gini(depth: DataFrame) -> DataFrame:
    """cell, gini: twice the rounded area between the diagonal and the Lorenz curve of the cell's counts.

    Equal counts are grouped before the sort: a run of n equal counts c on top of m bins with sum s adds
    n * s + c * n * (n + 1) / 2 to the summed running total.
    """
    runs = depth.groupBy("cell", "count").agg(F.count("*").alias("n_"))
    below = Window.partitionBy("cell").orderBy("count").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("s_", F.coalesce(F.sum(F.col("count") * F.col("n_")).over(below), F.lit(0)))
    n, c = F.col("n_").cast("double"), F.col("count").cast("double")
    per_cell = runs.groupBy("cell").agg(F.sum(n * F.col("s_") + c * n * (n + 1) / 2).alias("cum_"), F.sum(c * n).alias("total_"), F.sum(n).alias("bins_"))
    area = (F.try_divide("cum_", "total_") - 0.5) / F.col("bins_")
    return per_cell.select("cell", (2 * F.bround(0.5 - area, 4)).alias("gini"))


def classified(ginis: DataFrame, normal: float = 0.12, exclude: float = 0.5) -> DataFrame:
    """Adds is_normal (at most `normal`) and excluded (over `exclude`)."""
    return ginis.withColumn("is_normal", F.col("gini") <= normal).withColumn("excluded", F.col("gini") > exclude)
