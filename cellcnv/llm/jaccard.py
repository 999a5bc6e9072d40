"""Exact join of texts whose sets of word n-grams have a Jaccard index of 0.8 or more, by rare-first prefix filtering.

A set is ordered by how many sets of the corpus hold its n-grams, rare ones first. Two sets of n and m n-grams with an
index of at least 0.8 share one of the first n - ceil(0.8 n) + 1 of each. N-grams that no other set holds come first and
meet nothing, so most texts keep no prefix at all; the rest join on the n-grams of their prefixes, and a pair goes on
only if it passes the filters of

* length: 5 min(n, m) >= 4 max(n, m);
* position: with n - i and m - j n-grams from the place of meeting on, the overlap is at most the smaller of both;
* suffix: behind the place of meeting, counts of both sets in CELLS cells bound the overlap.

A pair that passes at its first common n-gram is compared once, by whole sets.

Counting: the n-grams of a piece of the corpus (some thousand texts) are dealt to buckets, 8 bytes each; a bucket
counts them and sends those of two sets or more back to their piece, where prefixes are cut. So whole sets are never
stored, and a bucket's size is bounded, as their number follows the size of the corpus.

Components: where over SMALL sets meet at an n-gram, all are compared with a few of them, in rounds (1, then four times
as many or more, where that makes no more pairs than there were keys at first), and pairs that are connected by then are left out, so a large group of near-copies takes comparisons in proportion
to its size. No round holds all pairs of a group; unlike texts that meet and pass all filters are each compared in the end.

Defined results: texts without words have an empty set, linked with nothing, not even each other; rows with equal sets
are one component; repeated rows share it; a null doc_id gets a component but never names one (null if no other id is in
it); an empty table gives an empty result; extra columns are ignored. The scan of docs has to give the same rows in the
same order when a task is repeated, as that of a table's files does; other inputs are stored first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, settled, stored, table
from .simhash import components

#: Texts and code points of a piece; code points to a bucket, buckets at least.
PIECE_ROWS, PIECE_CHARS = 8192, 1 << 23
BUCKET_CHARS, BUCKETS = 1 << 24, 64
CELLS = 32
SMALL = 8
#: Where sets meet.
KEY = ["bucket", "gram"]
#: What stands for a null doc_id.
LAST = (1 << 63) - 1
#: Meetings, and nodes with what their filters need, that are broadcast at most: 12 MB each.
MEETING_ROWS, NODE_ROWS = 200_000, 50_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str, words_each: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of a text's n-grams of words, sorted."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return np.zeros(0, np.uint64)
    each = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
    n = min(words_each, len(words))
    found = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        found = found * MIX + each[k : len(words) - n + 1 + k]
    found ^= found >> np.uint64(31)
    return np.unique(found * MIX)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (4 * n + 4) // 5 + (n > 0)


def overlap_may_do(most, n, m):
    """Whether an overlap of at most `most` may give sets of n and m n-grams an index of 0.8."""
    return 9 * most >= 4 * (n + m)


def _pieces(batches):
    """Slices of PIECE_ROWS rows and PIECE_CHARS code points at most, but for single rows with more."""
    for batch in batches:
        size = pc.fill_null(pc.utf8_length(batch.column("text_")), 0).to_numpy()
        ends = np.cumsum(np.append(0, size), dtype=np.int64)
        start = 0
        while start < len(batch):
            stop = int(np.searchsorted(ends, ends[start] + PIECE_CHARS, side="right")) - 1
            stop = max(start + 1, min(start + PIECE_ROWS, stop))
            yield batch.slice(start, stop - start)
            start = stop


def _dealt(buckets: int, words_each: int):
    """Of each piece a row for every bucket with its n-grams (48 bits each, and which set holds it), and one with its sets."""

    def run(batches):
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(_pieces(batches)):
            place: dict[bytes, int] = {}
            sets, own = [], []
            for t in batch.column("text_").to_pylist():
                found = shingle_hashes(t or "", words_each)
                digest = xxhash.xxh3_128_digest(found.tobytes())
                if digest not in place:
                    place[digest] = len(sets)
                    sets.append(found)
                own.append(place[digest])
            sizes = [len(s) for s in sets]
            grams = np.concatenate(sets)
            del sets
            owner = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
            order = np.argsort(grams)
            grams, owner = grams[order], owner[order]
            del order
            bucket = (grams >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
            cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            del bucket
            some = np.flatnonzero(np.diff(cut))
            low = grams.view(np.uint16).reshape(-1, 4)[:, :3] if len(grams) else np.zeros((0, 3), np.uint16)
            piece = part << 32 | number
            head = {"docs": batch.column("doc_").to_pylist(), "texts": batch.column("at_").to_pylist(), "own": own, "digests": list(place), "n": sizes}
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array([*some.tolist(), piece * 7919 % buckets], pa.int32()),
                    "piece": pa.array([piece] * (len(some) + 1), pa.int64()),
                    "grams": pa.array([*(low[cut[k] : cut[k + 1]].tobytes() for k in some), None], pa.binary()),
                    "owners": pa.array([*(owner[cut[k] : cut[k + 1]].tobytes() for k in some), None], pa.binary()),
                    "head": pa.array([None] * len(some) + [head], HEAD),
                }
            )

    return run


HEAD = pa.struct([("docs", pa.list_(pa.int64())), ("texts", pa.list_(pa.int64())), ("own", pa.list_(pa.int32())), ("digests", pa.list_(pa.binary())), ("n", pa.list_(pa.int32()))])
HEAD_DDL = "head struct<docs: array<long>, texts: array<long>, own: array<int>, digests: array<binary>, n: array<int>>"


def _grams(column) -> list[np.ndarray]:
    out = []
    for x in column.to_pylist():
        wide = np.zeros((len(x or b"") // 6, 4), np.uint16)
        wide[:, :3] = np.frombuffer(x or b"", np.uint16).reshape(-1, 3)
        out.append(wide.view(np.uint64).reshape(-1))
    return out


def _shared(group: pa.Table) -> pa.Table:
    """Of a bucket's rows only the n-grams of two sets or more, with the number of sets."""
    rows = _grams(group.column("grams"))
    cut = np.cumsum([0, *map(len, rows)])
    grams = np.concatenate(rows)
    del rows
    order = np.argsort(grams)
    held = grams[order]
    runs = np.diff(np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1], [True]]))) if len(held) else np.zeros(0, np.int64)
    del held
    count = np.empty(len(grams), np.uint32)
    count[order] = np.repeat(runs.astype(np.uint32), runs)
    del order
    out: dict[str, list] = {"grams": [], "owners": [], "counts": []}
    for k, (owner, head) in enumerate(zip(group.column("owners").to_pylist(), group.column("head").is_valid().to_pylist())):
        counts = count[cut[k] : cut[k + 1]]
        keep = counts > 1
        out["grams"].append(None if head else grams[cut[k] : cut[k + 1]][keep].tobytes())
        out["owners"].append(None if head else np.frombuffer(owner, np.uint16)[keep].tobytes())
        out["counts"].append(None if head else counts[keep].tobytes())
    made = pa.table({"bucket": group.column("bucket"), "piece": group.column("piece"), **{k: pa.array(v, pa.binary()) for k, v in out.items()}, "head": group.column("head").cast(HEAD)})
    return made.filter(pa.array([bool(c) or c is None for c in out["counts"]]))


def _cut(group: pa.Table) -> pa.Table:
    """A row for each set of a piece: its texts, size, prefix n-grams with their places, and what the suffix filter needs."""
    head = next(h for h in group.column("head").to_pylist() if h)
    n = np.array(head["n"], np.int64)
    data = [np.concatenate([np.zeros(0, kind), *(np.frombuffer(x or b"", kind) for x in group.column(c).to_pylist())]) for c, kind in (("grams", np.uint64), ("owners", np.uint16), ("counts", np.uint32))]
    grams, owner, count = data
    bucket = np.repeat(group.column("bucket").to_numpy(), [len(x or b"") // 8 for x in group.column("grams").to_pylist()])
    order = np.lexsort((grams, bucket, count, owner))
    grams, owner, bucket = grams[order], owner[order], bucket[order]
    start = np.searchsorted(owner, np.arange(len(n) + 1))
    shared = np.diff(start)
    taken = np.minimum(np.maximum(0, prefix_length(n) - (n - shared)), shared)
    cell = (grams % np.uint64(CELLS)).astype(np.int64)
    keys, cells, marks = [], [], []
    for k in range(len(n)):
        a, b = start[k], start[k] + taken[k]
        keys.append([{"bucket": x, "gram": g, "at": i} for x, g, i in zip(bucket[a:b].tolist(), grams[a:b].astype(np.int64).tolist(), range(n[k] - shared[k], n[k] - shared[k] + taken[k]))])
        cells.append(np.bincount(cell[a : start[k + 1]], minlength=CELLS).astype("<u4").tobytes() if b > a else None)
        marks.append(cell[a:b].astype(np.uint8).tobytes() if b > a else None)
    texts: list[list[dict]] = [[] for _ in n]
    for doc, at, k in zip(head["docs"], head["texts"], head["own"]):
        texts[k].append({"doc_": doc, "at_": at})
    node = (group.column("piece")[0].as_py() << 16) + np.arange(len(n))
    return pa.table(
        {
            "node": pa.array(node, pa.int64()),
            "digest": pa.array(head["digests"], pa.binary()),
            "n": pa.array(n, pa.int32()),
            "texts": pa.array(texts, pa.list_(pa.struct([("doc_", pa.int64()), ("at_", pa.int64())]))),
            "keys": pa.array(keys, pa.list_(pa.struct([("bucket", pa.int32()), ("gram", pa.int64()), ("at", pa.int32())]))),
            "cells": pa.array(cells, pa.binary()),
            "marks": pa.array(marks, pa.binary()),
        }
    )


def sets_of(read: DataFrame, words_each: int) -> DataFrame:
    """A row for each distinct set of a piece of the corpus, with its prefix."""
    chars = read.agg(F.sum(F.char_length("text_"))).first()[0] or 0
    buckets = max(BUCKETS, -(-chars // BUCKET_CHARS))
    dealt = read.mapInArrow(_dealt(buckets, words_each), f"bucket int, piece long, grams binary, owners binary, {HEAD_DDL}")
    shared = dealt.groupBy("bucket").applyInArrow(_shared, f"bucket int, piece long, grams binary, owners binary, counts binary, {HEAD_DDL}")
    return shared.groupBy("piece").applyInArrow(_cut, "node long, digest binary, n int, texts array<struct<doc_: long, at_: long>>, keys array<struct<bucket: int, gram: long, at: int>>, cells binary, marks binary")


def _suffixes(batches):
    """Keeps the pairs whose overlap may do by the counts behind their place of meeting."""

    def behind(cells: list[bytes], marks: list[bytes], places: np.ndarray, n: np.ndarray) -> np.ndarray:
        left = np.frombuffer(b"".join(cells), "<u4").reshape(-1, CELLS).astype(np.int64)
        for k, (mark, at, size) in enumerate(zip(marks, places, n)):
            passed = at + 1 - (size - left[k].sum())  # of the n-grams that other sets hold, those up to the place
            left[k] -= np.bincount(np.frombuffer(mark[:passed], np.uint8), minlength=CELLS)
        return left

    for batch in batches:
        if len(batch):
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
            a, b = (behind(batch.column(f"cells_{x}").to_pylist(), batch.column(f"marks_{x}").to_pylist(), batch.column(f"at_{x}").to_numpy(), size) for x, size in (("a", n), ("b", m)))
            keep = overlap_may_do(1 + np.minimum(a, b).sum(axis=1), n, m)
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def _whole_sets(words_each: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_hashes(t or "", words_each).tobytes() for t in batch.column("text_").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "set"])

    return run


def _similar(batches):
    for batch in batches:
        pairs = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())]
        keep = [bool(overlap_may_do(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))) for x, y in pairs]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "similar"])


def _sides(df: DataFrame, *columns: str) -> list[DataFrame]:
    return [df.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns)) for x in ("a", "b")]


def _compared(pairs: DataFrame, read: DataFrame, nodes: DataFrame, words_each: int) -> DataFrame:
    """a, b and whether they are similar, of the pairs that pass the suffix filter."""
    left, right = _sides(nodes, "n", "cells", "marks")
    if nodes.count() <= NODE_ROWS:
        left, right = F.broadcast(left), F.broadcast(right)
    pairs = few(stored(pairs.join(left, "a").join(right, "b").mapInArrow(_suffixes, "a long, b long"), "pairs"))
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    asked = few(stored(nodes.join(few(asked), "node", "left_semi").select("node", "text.*"), "asked"))
    texts = read.join(asked, ["doc_", "at_"]).select("node", "text_").dropDuplicates(["node"])
    sets = stored(texts.mapInArrow(_whole_sets(words_each), "node long, set binary"), "sets")
    left, right = _sides(sets, "set")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(_similar, "a long, b long, similar boolean")


def _meetings(keys: DataFrame, labels: DataFrame | None, pivots: int) -> DataFrame:
    """The keys at which sets of different labels may be similar, each with the number of sets and `pivots` of them at most.

    With r n-grams from the place of meeting on, two sets pass the filter of position if 9 r - 4 n, the room of one, is
    at least 4 times the size of the other, both ways. So a set goes if its room is too small for the smallest set of
    another label, or no other label has room for it; and only sets with room for their own size need to be pivots, as
    the smaller one of any such pair has. A key without pivots is done with.
    """
    small = keys.count() <= MEETING_ROWS  # then tables with a row for each key are broadcast
    some = F.broadcast if small else lambda df: df
    named = keys.withColumn("label", F.col("node")) if labels is None else keys.join(few(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = named.withColumn("room", 9 * (F.col("n") - F.col("at")) - 4 * F.col("n"))
    of_label = named.groupBy(*KEY, "label").agg(F.count("*").alias("m"), F.min("n").alias("low"), F.max("room").alias("high"))
    ends = of_label.groupBy(*KEY).agg(F.count("*").alias("labels"), F.sum("m").alias("sets"), F.min(F.struct("low", "label")).alias("least"), F.max(F.struct("high", "label")).alias("most")).where("labels > 1")
    # The smallest size and the largest room, and those of all other labels than the one that has them.
    second = of_label.select(*KEY, "label", "low", "high").join(some(ends), KEY).groupBy(*KEY).agg(
        F.first("sets").alias("m"), F.first("least").alias("least"), F.first("most").alias("most"),
        F.min(F.when(F.col("label") != F.col("least.label"), F.col("low"))).alias("low"), F.max(F.when(F.col("label") != F.col("most.label"), F.col("high"))).alias("high"),
    )
    low = F.when(F.col("label") == F.col("least.label"), F.col("low")).otherwise(F.col("least.low"))
    high = F.when(F.col("label") == F.col("most.label"), F.col("high")).otherwise(F.col("most.high"))
    alive = named.join(some(second), KEY).where((F.col("room") >= 4 * low) & (high >= 4 * F.col("n"))).select(*KEY, "node", "n", "at", "label", "room", "m")
    alive = stored(alive, "meetings")
    # The smallest sets come first: what all of a group share is most likely to be most of one of them.
    slots = alive.where("room >= 4 * n").groupBy(*KEY, F.pmod(F.xxhash64("node"), F.lit(pivots)).alias("slot")).agg(F.min(F.struct("n", "node", "at", "label")).alias("p"))
    return alive.drop("room").join(some(slots.groupBy(*KEY).agg(F.collect_list("p").alias("p"))), KEY)


def _pairs_met(met: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b with their places of meeting that pass the filters of length and position, and the keys that go on."""
    close, many = met.where(F.col("m") <= small), met.where(F.col("m") > small)
    other = few(close.select(*KEY, F.struct("n", "node", "at", "label").alias("q")), MEETING_ROWS)

    def fits(q: Column) -> Column:
        rest = F.least(F.col("n") - F.col("at"), q["n"] - q["at"])
        lengths = 5 * F.least(F.col("n"), q["n"]) >= 4 * F.greatest(F.col("n"), q["n"])
        return (F.col("label") != q["label"]) & lengths & overlap_may_do(rest, F.col("n"), q["n"])

    both = close.join(other, KEY).where((F.col("node") < F.col("q.node")) & fits(F.col("q"))).select("node", "n", "at", "label", "q")
    # In a large group all meet its pivots; a pivot is done with after that.
    both = both.unionByName(many.select("node", "n", "at", "label", F.explode(F.filter("p", fits)).alias("q")).where(F.col("node") != F.col("q.node")))
    first = F.col("node") < F.col("q.node")
    ends = [F.struct(F.col("node"), F.col("at")), F.col("q")]
    pairs = both.select(*(F.when(first, x[f]).otherwise(y[f]).alias(f"{name}{side}") for side, (x, y) in (("a", ends), ("b", ends[::-1])) for f, name in (("node", ""), ("at", "at_"))))
    pairs = pairs.groupBy("a", "b").agg(F.min(F.struct("at_a", "at_b")).alias("at")).select("a", "b", "at.*")
    on = many.where(~F.exists("p", lambda p: p["node"] == F.col("node"))).select(*KEY, "node", "n", "at")
    return pairs, on


def set_links(read: DataFrame, sets: DataFrame, words_each: int, small: int, first=None) -> DataFrame | None:
    """node and root of all nodes that are similar to another or connected by such ones; None if there are none. sets has one row for each distinct set.

    first(nodes) may give pairs (a, b, at_a, at_b) that are compared before all others.
    """
    spark = read.sparkSession
    nodes = stored(sets.where(F.size("keys") > 0).select("node", "n", "cells", "marks", F.col("texts")[0].alias("text"), "keys"), "nodes")
    every = nodes.select("node", "n", F.explode("keys").alias("k")).select("k.bucket", "k.gram", "node", "n", "k.at")
    shared = every.groupBy(*KEY).count().where("count > 1").select(*KEY)
    keys = settled(spark, lambda: every.join(shared, KEY, "left_semi"), "keys")
    labels = refused = None

    def compare(pairs):
        nonlocal labels, refused
        found = settled(spark, lambda: _compared(pairs(), read, nodes, words_each), "compared")
        more = found.where("similar").select("a", "b")
        no = found.where("NOT similar").select("a", "b")
        refused = no if refused is None else refused.unionByName(no)
        if not more.isEmpty():
            # What was connected before is a link to its root.
            links = more if labels is None else more.unionByName(labels.select(F.col("label").alias("a"), F.col("node").alias("b")))
            labels = settled(spark, lambda: components(links).select("node", F.col("root").alias("label")), "labels")

    if first is not None:
        compare(lambda: first(nodes))
    pivots, most = 1, keys.count()
    while True:
        met = stored(_meetings(keys, labels, pivots), "meetings")
        if met.isEmpty():
            return None if labels is None else labels.withColumnRenamed("label", "root")
        pairs, keys = _pairs_met(met, small)
        if refused is not None:
            pairs = pairs.join(few(refused), ["a", "b"], "left_anti")
        compare(lambda: pairs)  # noqa: B023
        # More pivots where that makes no more pairs than there were keys at first.
        pivots = max(4 * pivots, most // max(1, keys.count()))


def similar_texts(docs: DataFrame, words_each: int = 5, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    read = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_"), F.xxhash64("text").alias("at_"), F.col("text").alias("text_"))
    sets = stored(sets_of(read, words_each), "pieces")
    # Pieces hold a set once; the first piece with it stands for all.
    lowest = stored(sets.where("n > 0").groupBy("digest").agg(F.min("node").alias("node")), "sets")
    roots = set_links(read, sets.join(lowest.select("node"), "node", "left_semi"), words_each, small)
    if roots is None:
        rooted = lowest.withColumn("root", F.col("node"))
    else:
        rooted = lowest.join(few(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # A set has one row a piece at most, so copies meet in few rows.
    named = sets.where("n > 0").groupBy("digest").agg(F.min(F.array_min("texts.doc_")).alias("low")).join(rooted, "digest")
    names = named.groupBy("root").agg(F.min("low").alias("component_id"))
    found = stored(named.join(names, "root").select("digest", "component_id"), "named")
    rows = sets.join(found, "digest", "left").select("n", "component_id", F.explode("texts.doc_").alias("doc_"))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_"))
    return rows.select(F.nullif("doc_", F.lit(LAST)).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.nullif(component, F.lit(LAST)).alias("component_id"))


def op11_ngram_jaccard(spark, sf_dir):
    return similar_texts(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end s from words
), sized as (
  select doc_id, cast(len(s) as bigint) n from sets
), grams as (
  select doc_id, unnest(s) g from sets
), shared as (
  select doc_id, g from grams where g in (select g from grams group by g having count(*) > 1)
), common as (
  select a.doc_id a, b.doc_id b, count(*) c from shared a join shared b on a.g = b.g and a.doc_id < b.doc_id group by all
), links as (
  select a, b from common join sized x on x.doc_id = a join sized y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)
), edges as (
  select a, b from links union all select b, a from links
), reached as (
  select a, b from edges union select r.a, e.b from reached r join edges e on r.b = e.a
)
select doc_id, n n_shingles, least(doc_id, coalesce(low, doc_id)) component_id from sized left join (select a, min(b) low from reached group by a) on a = doc_id
"""
