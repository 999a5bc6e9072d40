"""SimHash near-duplicates: vantage-point trees over fingerprints.

Whole texts are reduced to 64-bit SimHash fingerprints of their word shingles. Distinct fingerprints are dealt
to shards by a vantage-point tree, grown from a bounded sample: at each node the Hamming distance to a vantage
fingerprint is at most, or over, a radius. A fingerprint lives in one shard; by the triangle inequality a
partner within `radius` bits can only live where the distance to each vantage differs by `radius` at most, so
the fingerprint also visits those later shards. A shard grows a tree of its own points and compares them leaf by
leaf, so a shard may be large where the corpus is: with the sample's 8,192 leaves and more, a shard of 100 million
fingerprints has some ten thousands, of 8 bytes each. Only the links of a spanning forest leave a leaf. Components of
the links come from alternating star contraction.

Defined results: texts without words have fingerprint zero and link like any other; repeated rows share their
component; a null doc_id gets a component but never names one (null if no other id is in it); an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, settled, stored, table, texts

SEED = 42
#: Points of a shard that are compared with each other without a tree.
LEAF_POINTS = 2048


def fingerprint(text: str, shingle: int = 3) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests = xxhash.xxh64_digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-shingle] + 1).tolist()]
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())])
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(rows), 4096):
        ones += np.unpackbits(rows[k : k + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every whole text."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


class VantageTree:
    """Inner nodes hold a vantage fingerprint and a radius; leaves are numbered from the left."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 3):
        self.rng, self.leaves = np.random.default_rng(seed), 0
        self.root = self._grow(sample.astype(np.uint64), depth)
        del self.rng

    def _grow(self, points: np.ndarray, depth: int):
        if depth > 0 and len(points) >= 8:
            best = None
            for vantage in self.rng.choice(points, min(8, len(points)), replace=False):
                distance = np.bitwise_count(points ^ vantage)
                cut = int(np.median(distance))
                inside = distance <= cut
                # Few points near the border, few visits; an even split, small shards.
                cost = np.mean((distance >= cut - 1) & (distance <= cut + 2)) + abs(inside.mean() - 0.5)
                if 0 < inside.sum() < len(points) and (best is None or cost < best[0]):
                    best = (cost, vantage, cut, inside)
            if best is not None:
                _, vantage, cut, inside = best
                left = self._grow(points[inside], depth - 1)
                return vantage, cut, left, self._grow(points[~inside], depth - 1)
        self.leaves += 1
        return self.leaves - 1

    def route(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Point numbers, shards and whether the shard is the point's home; visits go to shards after the home only."""
        home, visits = np.zeros(len(points), np.int64), []

        def down(node, at, own):
            if not len(at):
                return
            if not isinstance(node, tuple):
                home[at[own]] = node
                visits.append((at, np.full(len(at), node)))
                return
            vantage, cut, left, right = node
            distance = np.bitwise_count(points[at] ^ vantage).astype(np.int64)
            inside = distance <= cut
            # A point of the right shard has no partner to look for on the left: that partner visits the right.
            go = own & inside | ~own & (distance - radius <= cut)
            down(left, at[go], own[go])
            go = own | (distance + radius > cut)
            go &= ~(own & inside) | (distance + radius > cut)
            down(right, at[go], (own & ~inside)[go])

        down(self.root, np.arange(len(points)), np.ones(len(points), bool))
        at, shard = (np.concatenate(x) for x in zip(*visits)) if visits else (np.zeros(0, np.int64),) * 2
        return at, shard, home[at] == shard


def spanning_links(points: np.ndarray, at_home: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs within the radius, of which one lives here at least, by comparing all."""
    home, guests = points[at_home], points[~at_home]
    if len(guests):
        near = np.zeros(len(guests), bool)
        for k in range(0, len(home), 64):
            near |= (np.bitwise_count(home[k : k + 64, None] ^ guests[None, :]) <= radius).any(axis=0)
        guests = guests[near]
    left, out = np.unique(np.concatenate([home, guests])), []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            point = frontier.pop()
            near = np.bitwise_count(left ^ point) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                frontier.extend(found)
                out.extend((point, f) for f in found)
    return out


def links_within(points: np.ndarray, at_home: np.ndarray, radius: int, most: int = LEAF_POINTS) -> list[tuple[int, int]]:
    """Links that connect all pairs within the radius, of which one lives here at least.

    More than `most` points get a tree of their own, grown from them, and are compared leaf by leaf. A leaf that is
    still larger holds points so close together that no vantage parts them further; it is compared as it is.
    """
    if len(points) <= most:
        return spanning_links(points, at_home, radius)
    depth = int(np.ceil(np.log2(2 * len(points) / most)))
    tree = VantageTree(points[np.random.default_rng(5).permutation(len(points))[: 64 << depth]], depth)
    at, shard, _ = tree.route(points, radius)
    order = np.argsort(shard, kind="stable")
    out = []
    for leaf in np.split(at[order], np.flatnonzero(np.diff(shard[order])) + 1):
        if at_home[leaf].any():
            out += spanning_links(points[leaf], at_home[leaf], radius)
    return out


def near_links(nodes: DataFrame, radius: int = 2, shard_rows: int = 1500, sample_rows: int = 65_536) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of `nodes` that keep all their components."""
    n = nodes.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / shard_rows)))))
    take = min(sample_rows, 64 << depth)
    sample = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(take).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = VantageTree(sample, depth)

    def routed(batches):
        for batch in batches:
            points = batch.column("fp").to_numpy().view(np.uint64)
            at, shard, own = tree.route(points, radius)
            yield pa.RecordBatch.from_arrays([pa.array(points[at].view(np.int64)), pa.array(shard.astype(np.int32)), pa.array(own)], ["fp", "shard", "at_home"])

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        found = links_within(group["fp"].to_numpy(np.int64).view(np.uint64), group["at_home"].to_numpy(bool), radius)
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    dealt = nodes.select("fp").mapInArrow(routed, "fp long, shard int, at_home boolean")
    return dealt.groupBy("shard").applyInPandas(compared, "a long, b long")


def _forest(batches):
    """Of each batch of links as few that connect the same nodes, each to the smallest."""
    for batch in batches:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]  # noqa: B023
            return x

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        pairs = [(find(x), x) for x in root]
        pairs = [p for p in pairs if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every node with a link: alternating large and small stars.

    Each round is written to the shared folder, so its lineage is short and executors may be lost. Links never get more,
    so repeated ones stay; what a round takes of each node also tells whether the links are stars by now.
    """
    links = links.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).where("a < b")
    links = stored(links.mapInArrow(_forest, "a long, b long"), "links")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = F.when(F.col("b") < F.col("a"), F.col("b"))
        # Done when every node hangs on one root and no root hangs on anything.
        seen = both.groupBy("a").agg(F.min("b").alias("low"), F.min(parent).alias("root"), F.max(parent).alias("last"), F.max("b").alias("high"))
        seen = stored(seen.select("a", F.least("a", "low").alias("low"), (F.col("root").isNotNull() & ((F.col("root") != F.col("last")) | (F.col("high") > F.col("a")))).alias("hangs")), "lowest")
        if seen.where("hangs").isEmpty():
            return seen.select(F.col("a").alias("node"), F.col("low").alias("root"))
        large = both.join(few(seen.select("a", "low")), "a").where("b > a").select(F.col("low").alias("a"), "b").where("a < b")
        large = stored(large, "links")
        lowest = stored(large.groupBy("b").agg(F.min("a").alias("low")), "lowest")
        small = large.join(few(lowest), "b").select(F.col("low").alias("a"), F.when(F.col("a") == F.col("low"), F.col("b")).otherwise(F.col("a")).alias("b"))
        links = stored(small.where("a < b"), "links")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = settled(docs.sparkSession, lambda: components(near_links(nodes, radius)), "roots")
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """The rows of docs whose id names their component; of repeated rows of that id, all stay."""
    found = near_duplicates(docs, radius, shingle)
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("gone_")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_"], "left_anti")


def op6_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
