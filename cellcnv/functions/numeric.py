"""Rounding and robust statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Makes the median absolute deviation consistent for normal data.
MAD_SCALE = 1.4826


def signif(x: Column, digits: int = 3) -> Column:
    """x at a number of significant digits, half to even; zero stays zero."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * scale) / scale)


def median_and_mad(df: DataFrame, column: str) -> DataFrame:
    """One row: the median of a column and its scaled median absolute deviation."""
    centre = df.agg(F.median(column).alias("median"))
    away = df.select(column).crossJoin(F.broadcast(centre)).agg((MAD_SCALE * F.median(F.abs(F.col(column) - F.col("median")))).alias("mad"))
    return centre.crossJoin(away)


def low_quantile(df: DataFrame, column: str, p: float = 0.005) -> float:
    """Exact interpolated quantile of a low p without sorting everything in one task.

    An approximate quantile above p cuts the table; what lies below it is counted and ranked exactly.
    """
    n, cut = df.agg(F.count(column), F.percentile_approx(column, min(1.0, p + 0.01), 1000)).first()
    if n == 0:
        raise ValueError(f"no values in {column}")
    at = p * (n - 1)
    tail = df.where(F.col(column) <= cut)
    least = tail.count()
    if least < at + 2:
        tail, least = df.where(F.col(column).isNotNull()), n
    # The order statistics around `at` are found in the tail by an exact percentile of the tail's own ranks.
    share = 0.0 if least == 1 else at / (least - 1)
    return float(tail.agg(F.percentile(column, F.lit(min(1.0, share)))).first()[0])
