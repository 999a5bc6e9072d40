"""Demultiplexing of a stream of SAM lines: the batch operator between a stream's source and sink, and its counters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..sources.reads import MOST_TAGS, with_barcode

#: Name under which a stream's counts are observed.
COUNTS = "demultiplexed"


def read_lines(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """New text files in a folder as a stream of lines."""
    reader = spark.readStream.format("text")
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader
    return reader.load(folder).select(F.col("value").alias("line"))


@dataclass(frozen=True)
class BatchCounts:
    batch: int
    total: int
    kept: int

    @property
    def fraction(self) -> float | None:
        return self.kept / self.total if self.total else None


@dataclass
class DemuxCounters(StreamingQueryListener):
    """Running counters of demultiplexing streams: total lines, kept lines and their ratio, by micro-batch and in sum.

    Add it to the session with `spark.streams.addListener`. A batch that runs again after a failure counts once.
    """

    batches: dict[tuple[str, int], BatchCounts] = field(default_factory=dict)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get(COUNTS)
        if seen is not None and progress.numInputRows:
            self.batches[str(progress.id), progress.batchId] = BatchCounts(progress.batchId, seen["total"], seen["kept"])

    @property
    def total(self) -> int:
        return sum(b.total for b in self.batches.values())

    @property
    def kept(self) -> int:
        return sum(b.kept for b in self.batches.values())

    @property
    def fraction(self) -> float | None:
        return self.kept / self.total if self.total else None


def demultiplex_stream(lines: DataFrame, barcodes: DataFrame, path: str, checkpoint: str, once: bool = True, most_tags: int = MOST_TAGS) -> StreamingQuery:
    """Write kept lines to a directory per barcode. The barcode list is static; no state is kept between batches.

    Lines are counted in the same pass, before those without a barcode go; a DemuxCounters of the session gets the counts.
    """
    marked = with_barcode(lines, barcodes, most_tags=most_tags).observe(COUNTS, F.count("*").alias("total"), F.count("barcode").alias("kept"))
    kept = marked.where("barcode IS NOT NULL").select(F.expr("substring(barcode, 1, length(barcode) - 2)").alias("barcode_dir"), "barcode", "line")
    writer = kept.writeStream.format("text").partitionBy("barcode_dir", "barcode").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start(path)
