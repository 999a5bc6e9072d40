"""Near-copies: SimHash fingerprints find the close ones, an exact set join the rest, down to a Jaccard index of 0.8.

First the vantage-point trees of `simhash` link texts whose fingerprints (of five-word shingles) differ in two bits at
most; their whole sets of shingles are compared, and what is connected by then needs no further comparison. Pairs with
an index of 0.8 are up to 11 of 64 bits apart and more, and at such a radius a vantage-point tree sends every
fingerprint to nearly every shard, so fingerprints alone can't promise all pairs. The rest comes from the sets, by the
prefix join of `jaccard`: counts over all texts put rare shingles first, texts meet at the shingles of their prefixes,
and where many meet at one they are compared with a few of them, in rounds (1, then 4, then 16 ...), from which pairs
that are connected by then are left out. Components of the links come from star contraction.

Defined results: of each component the row with the smallest doc_id stays (null ids last); rows with equal id and
equal text are one; texts without words are copies of each other; texts of up to five words are one
shingle; an empty table gives an empty result; all columns are kept. As in `jaccard`, the scan of docs has to give the
same rows in the same order when a task is repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, settled, stored
from .jaccard import LAST, SMALL, set_links, sets_of
from .simhash import fingerprint, near_links

WORDS = 5


def close_prints(read: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, at_a, at_b) of nodes that connect all fingerprints within two bits.

    Places are those before the first n-gram that a node shares with any other, so all of them count behind it.
    """

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t or "", WORDS) for t in batch.column("text_").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_"), batch.column("at_"), pa.array(found.view(np.int64), pa.int64())], ["doc_", "at_", "fp"])

    prints = read.mapInArrow(run, "doc_ long, at_ long, fp long").dropDuplicates(["doc_", "at_"])
    named = stored(nodes.select("node", "text.*", (F.col("keys")[0]["at"] - 1).alias("at")).join(prints, ["doc_", "at_"]).select("node", "at", "fp"), "fingerprints")
    low = stored(named.groupBy("fp").agg(F.min(F.struct("node", "at")).alias("low")), "lowest")
    pairs = named.join(low, "fp").where("node != low.node").select("low", F.struct("node", "at").alias("high"))
    near = near_links(low.select("fp"))
    for side, name in (("a", "low"), ("b", "high")):
        near = near.join(low.select(F.col("fp").alias(side), F.col("low").alias(f"{name}_")), side)
    pairs = pairs.unionByName(near.select(F.least("low_", "high_").alias("low"), F.greatest("low_", "high_").alias("high")))
    return pairs.select(F.col("low.node").alias("a"), F.col("high.node").alias("b"), F.col("low.at").alias("at_a"), F.col("high.at").alias("at_b"))


def _first_rows(read: DataFrame, small: int) -> DataFrame:
    """doc_ and at_ of the row that stays of each component. read has a row for each doc_ and at_ (a hash of text_)."""
    sets = stored(sets_of(read, WORDS), "pieces")
    # Pieces hold a set once; the first piece with it stands for all.
    lowest = stored(sets.groupBy("digest").agg(F.min("node").alias("node")), "sets")
    roots = set_links(read, sets.join(lowest.select("node"), "node", "left_semi"), WORDS, small, lambda nodes: close_prints(read, nodes))
    rooted = lowest.withColumn("root", F.col("node")) if roots is None else lowest.join(few(roots), "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    first = sets.groupBy("digest").agg(F.min(F.array_min("texts")).alias("low"))
    return first.join(rooted, "digest").groupBy("root").agg(F.min("low").alias("low")).select("low.*")


def one_of_near_copies(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """One row of each component of similar texts."""
    columns = docs.columns
    # Null ids come last. A row is known by its id and its text's hash; rows with both equal are one from here on.
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_")
    key = [doc, F.xxhash64("text").alias("at_")]
    kept = settled(docs.sparkSession, lambda: _first_rows(docs.select(*key, F.col("text").alias("text_")), small), "kept")
    # The row travels as one struct, so no column of the table can clash with those made here. Equal rows combine before they are shuffled.
    rows = docs.select(*key, F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row_")).groupBy("doc_", "at_").agg(F.first("row_").alias("row_"))
    left = rows.join(kept, ["doc_", "at_"], "left_semi")
    return left.select(*(F.col(f"row_.`{c}`").alias(c) for c in columns))
