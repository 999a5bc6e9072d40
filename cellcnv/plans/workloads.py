"""The workloads end to end on the inputs that are derived from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import stored
from ..operators import bins as b
from ..operators import coverage, gini, qc
from ..sources.tables import Inputs

#: Reads are kept from this mapping quality on; the derived qualities run from 1 to 50.
LEAST_MAPQ = 1


class Workload:
    """Lazy tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.inputs = spark, Inputs(spark, sf_dir)
        #: Bin width and bins follow the number of parts; both are a few rows.
        self.width = int(self.inputs.chroms().first()["w"])

    def bins(self) -> DataFrame:
        return b.tile(self.inputs.chroms(), self.width)

    def annotated_bins(self) -> DataFrame:
        return b.mappability(b.gc_content(self.bins(), self.inputs.seq_chunks(), self.width), self.inputs.mapp_track(), self.width)

    def depth(self) -> DataFrame:
        return coverage.coverage(self.inputs.reads(), self.bins(), self.width, self.inputs.mask(), LEAST_MAPQ)

    def metrics(self) -> DataFrame:
        return qc.qc_metrics(self.inputs.reads())

    def quality_controlled(self, **options) -> dict[str, DataFrame]:
        return qc.perform_qc(stored(self.depth(), "depth"), self.annotated_bins(), self.metrics(), **({"min_count": 1} | options))

    def normal_cells(self) -> DataFrame:
        return gini.classified(gini.gini(self.depth()))

    def expected(self) -> DataFrame:
        """cell, bin_idx, count, yhat: normal cells' mean count of the bin, scaled by the cell's total."""
        depth = stored(self.depth(), "depth")
        totals = depth.groupBy("cell").agg(F.sum("count").alias("total_"))
        normal = depth.join(F.broadcast(self.inputs.clones().where("clone = 'normal'").select("cell")), "cell", "left_semi")
        per_bin = normal.groupBy("bin_idx").agg(F.avg("count").alias("mean_"))
        whole = normal.agg((F.sum("count") / F.countDistinct("cell")).alias("whole_"))
        rows = depth.join(F.broadcast(totals), "cell").join(F.broadcast(per_bin), "bin_idx").crossJoin(F.broadcast(whole))
        yhat = F.greatest(F.lit(1.0), F.rint(F.col("mean_") * F.col("total_") / F.col("whole_")))
        return rows.select("cell", "bin_idx", "count", yhat.alias("yhat"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cells are normal?"""
    return Workload(spark, sf_dir).normal_cells().select("cell", F.bround("gini", 6).alias("gini"), "is_normal", "excluded")
