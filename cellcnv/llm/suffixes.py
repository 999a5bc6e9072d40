"""Removing repeated byte strings: merged Burrows-Wheeler transforms of candidate snippets.

A byte goes if a string of `length` bytes that covers it also starts earlier. Candidates: in every window of that
length the smallest of its gram hashes is its anchor (leftmost on ties), so equal windows have equal anchors
at equal offsets. A run of windows with one anchor is one occurrence: anchor hash, hash of its bytes, place.

1. Anchors that occur once in the corpus are done: their windows are unique. Counting combines before the shuffle.
2. Equal snippets of an anchor (64-bit hashes of their bytes) are joined before anything is gathered, so a group of
   copies, however large, is one string; its later copies are repeats, whole.
3. What is left, the different snippets of each anchor, is dealt to buckets by anchor; anchors with very many are
   dealt window by window instead, so that no bucket gets them all. Inside a bucket the snippets of each
   small shard are sorted into a Burrows-Wheeler transform, and the shards' transforms are merged: starting
   from the shards one after the other, the interleave is refined by stable passes over the transforms'
   symbols; each pass makes the order right for two more bytes, and where neighbours part their common prefix
   ends. After `length` bytes the blocks that never parted are the repeated intervals. Only rows that reach the
   start of a window take part, and a row that is alone in its block has nothing equal and leaves.

Defined results: null and empty texts have no bytes; documents shorter than `length` lose nothing; rows that repeat
a doc_id don't count as earlier than each other, and those that repeat its text too are one document; a null doc_id
is the lowest; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, settled, stored, table

GRAM = 24
#: Anchors with more snippets than this are dealt window by window.
HOT_SNIPPETS = 20_000
BUCKET_BYTES = 600_000
SHARD_BYTES = 60_000
CHUNK_BYTES = 1 << 18
OCCURRENCE = "doc_ long, text_ long, f_ long, h_ long, at_ long"
LOWEST = -(1 << 63)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each position, by three 8-byte words."""
    n = len(data) - GRAM + 1
    words = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    for shift in (8, 16):
        h ^= h >> np.uint64(29)
        h += words[shift : shift + n]
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def leftmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each i the leftmost position of the smallest of h[i : i + width], by doubling."""
    at, value, reach = np.arange(len(h), dtype=np.int32), h, 1
    while reach < width:
        step = min(reach, width - reach)
        right = value[step:] < value[:-step]
        at = np.where(right, at[step:], at[:-step])
        value = np.minimum(value[:-step], value[step:])
        reach += step
    return at


def occurrences_in(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in joined documents: document number, anchor hash, first window's start, number of windows."""
    if len(data) < length:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    h = gram_hashes(data)
    anchor = leftmost_minima(h, length - GRAM + 1)
    starts = np.concatenate([[0], ends[:-1]])
    begin, stop = starts[ends - starts >= length], ends[ends - starts >= length] - length + 1
    inside = np.zeros(len(anchor) + 1, np.int8)
    np.add.at(inside, begin, 1)
    np.add.at(inside, stop, -1)
    valid = np.cumsum(inside[:-1], dtype=np.int8) > 0
    fresh = valid.copy()
    fresh[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    fresh[begin] = True
    first = np.flatnonzero(fresh)
    doc = np.searchsorted(ends, first, side="right")
    last = np.minimum(np.concatenate([first[1:], [len(anchor)]]), ends[doc] - length + 1)
    return doc, h[anchor[first]], first, last - first


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """All anchor runs of all documents.

    at_ packs the first window's start, the number of windows and whether the run's bytes came earlier in the same
    document into one number, as these rows are shuffled.
    """

    def chunks(ids, keys, texts):
        held, size = [], 0
        for i, key, t in zip(ids, keys, texts):
            if size and size + len(t) > CHUNK_BYTES:
                yield held
                held, size = [], 0
            held.append((i, key, t))
            size += len(t)
        if held:
            yield held

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            for held in chunks(batch.column("doc_").to_pylist(), batch.column("text_").to_pylist(), texts):
                ids, keys, parts = zip(*held)
                joined, starts = b"".join(parts), np.cumsum([0, *map(len, parts)])
                doc, f, first, n = occurrences_in(np.frombuffer(joined, np.uint8), starts[1:], length)
                h = np.fromiter((digest(joined[a:b]) for a, b in zip(first.tolist(), (first + n + length - 1).tolist())), np.uint64, len(first))
                order = np.lexsort((first, h, f, doc))
                same = (doc[order][1:] == doc[order][:-1]) & (f[order][1:] == f[order][:-1]) & (h[order][1:] == h[order][:-1])
                again = np.zeros(len(first), bool)
                again[order[1:][same]] = True
                at = ((first - starts[doc]) << 16) + (n << 1) + again
                columns = [np.array(ids, np.int64)[doc], np.array(keys, np.int64)[doc], f.view(np.int64), h.view(np.int64), at]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_", "text_", "f_", "h_", "at_"])

    return docs.mapInArrow(run, OCCURRENCE)


class Collection:
    """Strings of one shard as cyclic rows that end with a sentinel (code 0; bytes have codes from 1 on)."""

    def __init__(self, strings: list[bytes], codes: np.ndarray):
        sizes = np.array([len(s) + 1 for s in strings], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.symbols = codes[np.frombuffer(b"".join([s + b"\0" for s in strings]), np.uint8)].astype(np.int64)
        self.symbols[self.begin + sizes - 1] = 0
        self.string = np.repeat(np.arange(len(strings)), sizes)
        self.first, self.size = self.begin[self.string], sizes[self.string]
        self.offset = np.arange(len(self.symbols)) - self.first

    def shifted(self, by: int) -> np.ndarray:
        """Position `by` symbols on, around the end of each string."""
        at = self.offset + by
        if 0 <= by < self.size.min():
            return self.first + np.where(at >= self.size, at - self.size, at)
        return self.first + at % self.size


class Transform:
    """A shard's rotations in the order of their first `depth` symbols at least, and its Burrows-Wheeler transform.

    before[n][row] codes the n symbols before a row (n = 1: the transform itself), back[n][row] is the row of the
    rotation that begins with them.
    """

    def __init__(self, rows: Collection, depth: int, n_codes: int):
        rank, known = rows.symbols, 1
        while known < 8 and n_codes ** (2 * known) < 1 << 62:
            rank = rank * n_codes**known + rank[rows.shifted(known)]
            known *= 2
        while True:
            order = np.argsort(rank)
            ordered = rank[order]
            rank = np.empty_like(rank)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            if known >= depth or rank[order[-1]] == len(rank) - 1:
                break
            rank = rank * len(rank) + rank[rows.shifted(known)]
            known *= 2
        row_of = np.empty_like(order)
        row_of[order] = np.arange(len(order))
        self.order, self.before, self.back = order, {}, {}
        one, two = rows.shifted(-1), rows.shifted(-2)
        self.before[1], self.back[1] = rows.symbols[one][order], row_of[one[order]]
        self.before[2], self.back[2] = (rows.symbols[two] * n_codes + rows.symbols[one])[order], row_of[two[order]]


def merge(transforms: list[Transform], rows: list[np.ndarray], depth: int, n_codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms by refining their interleave, for the given rows of each shard.

    Returns, in merged order, rows (numbered through all shards) and blocks, after `depth` symbols have been put
    before each; rows of a block have these in common. Rows alone in their block are left out.
    """
    shift = np.cumsum([0, *(len(t.order) for t in transforms)])
    before, back = {}, {}
    for step in (1, 2):
        joined = np.concatenate([t.before[step] for t in transforms])
        before[step] = joined.astype(np.uint16 if n_codes**step <= 1 << 16 else np.uint32)
        back[step] = np.concatenate([t.back[step] + s for t, s in zip(transforms, shift)]).astype(np.int32)
    interleave = np.concatenate([r + s for r, s in zip(rows, shift)]).astype(np.int32)
    block = np.zeros(len(interleave), np.int32)
    for n, step in enumerate([1] * (depth % 2) + [2] * (depth // 2)):
        symbols = before[step][interleave]
        order = np.argsort(symbols, kind="stable")
        symbols, block, interleave = symbols[order], block[order], back[step][interleave[order]]
        parted = np.concatenate([[True], (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])])[: len(block)]
        if n % 6 == 5 or n >= depth // 2 - 1:
            alone = parted & np.concatenate([parted[1:], [True]])[: len(block)]
            interleave, parted = interleave[~alone], parted[~alone]
        block = np.cumsum(parted, dtype=np.int32)
        if not len(block):
            break
    return interleave, block


def repeated_windows(strings: list[bytes], windows: np.ndarray, doc: np.ndarray, text: np.ndarray, lo: np.ndarray, length: int) -> np.ndarray:
    """For each window (string by string, windows[i] of string i) whether an equal one has a smaller doc, or starts earlier in the same text."""
    used = np.unique(np.frombuffer(b"".join(strings), np.uint8))
    codes, n_codes = np.zeros(256, np.int64), len(used) + 1
    codes[used] = np.arange(1, n_codes)
    shards, size = [[]], 0
    for i, s in enumerate(strings):
        if size > SHARD_BYTES:
            shards.append([])
            size = 0
        shards[-1].append(i)
        size += len(s)
    parts = [Collection([strings[i] for i in shard], codes) for shard in shards]
    made = [Transform(p, length, n_codes) for p in parts]
    # A window at offset o is reached from the row that begins right after it.
    rows = []
    for shard, part, t in zip(shards, parts, made):
        ahead = part.offset[t.order] - length
        rows.append(np.flatnonzero((ahead >= 0) & (ahead < windows[np.array(shard)][part.string[t.order]])))
    interleave, block = merge(made, rows, length, n_codes)
    shift = np.cumsum([0, *(len(t.order) for t in made)])
    first_window = np.cumsum(windows) - windows
    string, offset = (np.empty(len(interleave), np.int64) for _ in range(2))
    for k, (shard, part, t) in enumerate(zip(shards, parts, made)):
        mine = (interleave >= shift[k]) & (interleave < shift[k + 1])
        at = t.order[interleave[mine] - shift[k]]
        string[mine], offset[mine] = np.array(shard)[part.string[at]], part.offset[at]
    start = lo[string] + offset
    order = np.lexsort((start, text[string], doc[string], block))
    b, d, t = block[order], doc[string][order], text[string][order]
    head = np.concatenate([[True], b[1:] != b[:-1]])[: len(b)]
    first = np.maximum.accumulate(np.where(head, np.arange(len(b)), 0))
    same = np.concatenate([[False], (b[1:] == b[:-1]) & (d[1:] == d[:-1]) & (t[1:] == t[:-1])])[: len(b)]
    later = np.zeros(int(windows.sum()), bool)
    later[(first_window[string] + offset)[order]] = (d != d[first]) | same
    return later


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _repeats_in_bucket(length: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_", "text_", "lo_"], ignore_index=True)
        windows, doc, text, lo = (group[c].to_numpy(np.int64) for c in ("n_", "doc_", "text_", "lo_"))
        later = repeated_windows(group["bytes_"].tolist(), windows, doc, text, lo, length)
        out, at = [], 0
        for n, d, t, start in zip(windows.tolist(), doc.tolist(), text.tolist(), lo.tolist()):
            flags = later[at : at + n]
            at += n
            if flags.any():
                out.extend((d, t, start + a, start + b - 1 + length) for a, b in zip(*map(np.ndarray.tolist, _runs(flags))))
        return pd.DataFrame(out, columns=["doc_", "text_", "from_", "to_"])

    return run


def _cut(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of each wanted snippet: f_, h_, doc_, text_, lo_, n_, bytes_."""
    lists = wanted.groupBy("doc_", "text_").agg(F.collect_list(F.struct("f_", "h_", "lo_", "n_")).alias("want_"))
    # Rows that repeat an id and a text are one document.
    rows = docs.join(lists, ["doc_", "text_"])

    def run(batches):
        for batch in batches:
            rows = []
            for doc, key, text, want in zip(*(batch.column(c).to_pylist() for c in ("doc_", "text_", "text", "want_"))):
                data = text.encode()
                rows.extend((w["f_"], w["h_"], doc, key, w["lo_"], w["n_"], data[w["lo_"] : w["lo_"] + w["n_"] + length - 1]) for w in want)
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["f_", "h_", "doc_", "text_", "lo_", "n_", "bytes_"])

    return rows.mapInArrow(run, "f_ long, h_ long, doc_ long, text_ long, lo_ int, n_ int, bytes_ binary")


def _window_by_window(snippets: DataFrame, length: int) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0), F.col("n_") - 1))
    rows = snippets.select("f_", "doc_", "text_", "lo_", "bytes_", at.alias("o_"))
    window = F.substring(F.col("bytes_"), F.col("o_") + 1, F.lit(length))
    return rows.select("f_", "doc_", "text_", (F.col("lo_") + F.col("o_")).alias("lo_"), F.xxhash64(window).alias("window_"), F.xxhash64(F.lit(1), window).alias("again_"))


def repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_, text_, from_, to_: byte ranges that repeated windows cover. docs has doc_ and text_ (longs, not null) and text."""
    if not GRAM <= length < 1 << 15:
        raise ValueError(f"length must be from {GRAM} to {(1 << 15) - 1} bytes")
    found = occurrences(docs, length)
    counts = found.groupBy("f_").agg(F.count("*").alias("count_"), F.min("doc_").alias("first_"), (F.min("h_") != F.max("h_")).alias("several_")).where("count_ > 1").drop("count_")
    at = [F.shiftright("at_", 16).cast("int").alias("lo_"), F.shiftright(F.col("at_").bitwiseAND(0xFFFE), 1).cast("int").alias("n_"), (F.col("at_") % 2 == 1).alias("again_")]
    shared = stored(found.join(counts, "f_").select("doc_", "text_", "f_", "h_", *at, "first_", "several_"), "shared")
    span = ["doc_", "text_", F.col("lo_").alias("from_"), (F.col("lo_") + F.col("n_") + length - 1).alias("to_")]
    whole = shared.where("not several_ and (again_ or doc_ > first_)").select(*span)

    several = shared.where("several_").drop("first_", "several_")
    snippets = several.groupBy("f_", "h_").agg(F.min("doc_").alias("first_"))
    placed = several.join(snippets, ["f_", "h_"])
    copies = placed.where("again_ or doc_ > first_").select(*span)
    own = placed.where("not again_ and doc_ = first_").select("f_", "h_", "doc_", "text_", "lo_", "n_").dropDuplicates(["f_", "h_", "doc_", "text_"])
    own = stored(_cut(docs, own, length).dropDuplicates(["f_", "h_", "doc_", "text_"]), "snippets")
    sizes = own.groupBy("f_").agg(F.count("*").alias("k_"))
    hot = sizes.where(F.col("k_") > HOT_SNIPPETS).select("f_")
    total = own.agg(F.sum(F.length("bytes_")).alias("n")).first()["n"] or 0
    n_buckets = max(1, -(-total // BUCKET_BYTES))
    cool = own.join(hot, "f_", "left_anti").select("doc_", "text_", "lo_", "n_", "bytes_", bucket("f_", n=n_buckets, seed=1).alias("bucket_"))
    # Windows of a hot anchor are told apart by the anchor's and two more hashes, so no bucket gets them all.
    single = _window_by_window(own.join(hot, "f_", "left_semi"), length)
    one = ["f_", "window_", "again_"]
    starts = single.groupBy(*one, "doc_", "text_").agg(F.min("lo_").alias("low_"), F.collect_set("lo_").alias("at_"))
    least = starts.groupBy(*one).agg(F.min("doc_").alias("least_"))
    placed_hot = starts.join(least, one).select("doc_", "text_", "least_", "low_", F.explode("at_").alias("lo_"))
    later = placed_hot.where("doc_ > least_ or lo_ > low_").select("doc_", "text_", F.col("lo_").alias("from_"), (F.col("lo_") + length).alias("to_"))
    in_buckets = cool.groupBy("bucket_").applyInPandas(_repeats_in_bucket(length), "doc_ long, text_ long, from_ int, to_ int")
    return whole.unionByName(copies).unionByName(later).unionByName(in_buckets)


def _removed(length: int):
    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans_"))):
                data = text.encode()
                kept, n_spans, at = [], 0, 0
                for s in sorted((s["from_"], s["to_"]) for s in spans or ()):
                    if s[1] <= at and n_spans:
                        continue
                    if not n_spans or s[0] > at:
                        kept.append(data[at : s[0]])
                        n_spans += 1
                    at = s[1]
                kept.append(data[at:])
                left = b"".join(kept)
                rows.append((doc_id, len(data), len(data) - len(left), n_spans, left))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = docs.select("*", F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_"), F.xxhash64("text").alias("text_"))
    found = settled(docs.sparkSession, lambda: repeats(keyed.select("doc_", "text_", "text"), length), "repeats")
    spans = found.groupBy("doc_", "text_").agg(F.collect_set(F.struct("from_", "to_")).alias("spans_"))
    return keyed.join(spans, ["doc_", "text_"], "left").select("doc_id", "text", "spans_").mapInArrow(_removed(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffix_dedup(spark, sf_dir):
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
