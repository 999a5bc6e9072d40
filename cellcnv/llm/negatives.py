"""Hard negatives by exact integer scores: matrix products in a residue number system.

Components are whole numbers (floor of 256 times the component). Anchors and rows are multiplied as matrices modulo
several small primes in float32: residues are centred, and a block of COLUMNS components of two residues below the
largest prime sums up to less than 2^24, so every product is exact. The residues of a score are put together by Chinese
remaindering in mixed radix; the number of primes follows from the largest norm of the table (a score is at most the
product of two norms), so the signed score is exact. Two passes over the rows follow for every ANCHORS_AT_ONCE anchors,
which is all that is sent to the tasks at once: the first keeps each anchor's positives, the second the rows inside
each positive's window of scores. A task keeps the few best of its rows; a window puts the tasks' rows together.

Defined results: rows with a null label or vector, a null, NaN or infinite component, or a null vec_id take no part;
shorter vectors count as filled up with zeros; rows with the anchor's own vec_id are never its partners; an id that is
repeated is a row each time, also as an anchor; ties go to the smaller vec_id; an empty table gives an empty result;
extra columns are ignored. Vectors whose scores may exceed 2^46 are an error, never a wrong score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Components in a block, and anchors sent to the tasks at once: 16 MB at 64 components.
COLUMNS, ANCHORS_AT_ONCE = 64, 65_536
#: Scores of a tile, and rows of one: a score and a row's place in its tile are put into one number.
TILE, TILE_ROWS = 1 << 20, 1 << 13
LARGEST = 1 << 46
#: Stands for no row.
NONE = np.iinfo(np.int64).min


def primes_for(bound: float) -> list[int]:
    """The largest primes whose residues multiply exactly in float32 and whose product is over 2 * bound + 1."""
    top = 2 * int(np.sqrt((1 << 24) / COLUMNS))
    found, product = [], 1
    for p in range(top - 1, 2, -1):
        if product > 2 * bound + 1:
            break
        if all(p % k for k in range(2, int(p**0.5) + 1)):
            found.append(p)
            product *= p
    return found


def residues(whole: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """For each prime the centred residues, float32."""
    out = []
    for p in primes:
        r = np.mod(whole, p)
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def exact_products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed integer products of all rows of two matrices, given by their residues."""
    value, radix = np.zeros((len(left[0]), len(right[0])), np.int64), 1
    for a, b, p in zip(left, right, primes):
        rest = np.zeros(value.shape, np.int64)
        for k in range(0, a.shape[1], COLUMNS):
            rest += (a[:, k : k + COLUMNS] @ b[:, k : k + COLUMNS].T).astype(np.int64)
        # The next digit in mixed radix: what is missing from the value modulo this prime.
        digit = np.mod((rest - value) % p * pow(radix, -1, p), p)
        value += radix * digit
        radix *= p
    return np.where(value > radix // 2, value - radix, value)


def whole_numbers(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of every component, filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def first_of(scores: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the columns of its `most` largest allowed scores (the first column on ties) and whether they are any."""
    n = scores.shape[1]
    key = np.where(allowed, scores * n + (n - 1 - np.arange(n)), NONE)
    take = min(most, n)
    at = np.argpartition(key, n - take, axis=1)[:, n - take :] if take < n else np.broadcast_to(np.arange(n), key.shape)
    return at, np.take_along_axis(key, at, axis=1) != NONE


class Best:
    """The first `most` rows by score and smaller id for each of n keys, over all tiles that were added."""

    def __init__(self, n: int, most: int):
        self.scores, self.ids, self.most = np.full((n, most), NONE), np.zeros((n, most), np.int64), most

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, found: np.ndarray) -> None:
        scores = np.concatenate([self.scores[keys], np.where(found, scores, NONE)], axis=1)
        ids = np.concatenate([self.ids[keys], ids], axis=1)
        # NONE stands last; its negation would overflow.
        order = np.lexsort((ids, np.where(scores == NONE, np.iinfo(np.int64).max, -scores)), axis=-1)[:, : self.most]
        self.scores[keys], self.ids[keys] = np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, at = np.nonzero(self.scores != NONE)
        return key, self.ids[key, at], self.scores[key, at]


def _batches(batches, width: int, primes: list[int]):
    """Ids, labels and residues of at most TILE_ROWS rows at a time, by rising id."""
    for batch in (whole.slice(k, TILE_ROWS) for whole in batches for k in range(0, len(whole), TILE_ROWS)):
        ids = batch.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        whole = whole_numbers(batch.column("embedding"), width)[order]
        yield ids[order], batch.column("label").to_numpy()[order], residues(whole, primes)


def _positives(anchors, width: int, primes: list[int], most: int):
    """A task's nearest rows of each anchor's own label: only rows and anchors of one label are multiplied."""
    numbers, ids_, labels_, whole = anchors
    of = {label: np.flatnonzero(labels_ == label) for label in np.unique(labels_)}

    def run(batches):
        left, best = residues(whole, primes), Best(len(ids_), most)
        for ids, labels, right in _batches(batches, width, primes):
            for label in np.unique(labels):
                mine, rows = of.get(label, ()), np.flatnonzero(labels == label)
                some = [r[rows] for r in right]
                step = max(1, TILE // len(rows))
                for k in range(0, len(mine), step):
                    at = mine[k : k + step]
                    scores = exact_products([r[at] for r in left], some, primes)
                    column, found = first_of(scores, ids_[at][:, None] != ids[rows][None, :], most)
                    best.add(at, np.take_along_axis(scores, column, axis=1), ids[rows][column], found)
        key, partner, score = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(numbers[key]), pa.array(partner), pa.array(score)], ["anchor_no", "vec_id", "score"])

    return run


def _negatives(anchors, windows, width: int, primes: list[int], most: int):
    """A task's best rows of other labels inside each window: windows (anchor's place, upper score) of the anchors."""
    numbers, ids_, labels_, whole = anchors
    place, rank, upper = windows
    order = np.argsort(place, kind="stable")
    place, rank, upper = place[order], rank[order], upper[order]

    def run(batches):
        left, best = residues(whole, primes), Best(len(place), most)
        for ids, labels, right in _batches(batches, width, primes):
            step = max(1, TILE // len(ids))
            for k in range(0, len(ids_), step):
                at = np.arange(k, min(k + step, len(ids_)))
                scores = exact_products([r[at] for r in left], right, primes)
                other = (labels_[at][:, None] != labels[None, :]) & (ids_[at][:, None] != ids[None, :])
                own = np.arange(np.searchsorted(place, k), np.searchsorted(place, at[-1] + 1))
                for j in np.unique(rank[own]):
                    mine = own[rank[own] == j]
                    row, top = place[mine] - k, upper[mine][:, None]
                    seen = scores[row]
                    column, found = first_of(seen, other[row] & (seen <= top) & (100 * seen >= 80 * top), most)
                    best.add(mine, np.take_along_axis(seen, column, axis=1), ids[column], found)
        key, partner, score = best.rows()
        columns = [pa.array(numbers[place[key]]), pa.array(rank[key].astype(np.int32)), pa.array(partner), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, ["anchor_no", "positive", "vec_id", "score"])

    return run


def hard_negatives(embeddings: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 5, at_once: int = ANCHORS_AT_ONCE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: see the module's text."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    norm = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + F.pow(F.abs(x.cast("double")) * 256 + 1, 2))
    facts = rows.agg(F.max(F.size("embedding")).alias("width"), F.max(norm).alias("norm")).first()
    width, bound = facts["width"] or 0, facts["norm"] or 0.0
    if bound > LARGEST:
        raise ValueError(f"scores of up to {bound:.3g} are over 2^46")
    primes = primes_for(bound)
    anchors = rows.where(F.col("vec_id") % anchor_every == 0).select(F.monotonically_increasing_id().alias("anchor_no"), "vec_id", "label", "embedding")
    anchors = stored(anchors, "anchors")
    groups = -(-anchors.count() // at_once)
    group = F.pmod(F.xxhash64("anchor_no"), F.lit(max(1, groups)))
    found = []
    for g in range(groups):
        some = anchors.where(group == g).orderBy("anchor_no").toArrow().combine_chunks()
        whole = whole_numbers(some.column("embedding").combine_chunks(), width)
        block = (some.column("anchor_no").to_numpy(), some.column("vec_id").to_numpy(), some.column("label").to_numpy(), whole)
        near = rows.mapInArrow(_positives(block, width, primes, positives), "anchor_no long, vec_id long, score long")
        by_score = Window.partitionBy("anchor_no").orderBy(F.desc("score"), "vec_id")
        near = stored(near.withColumn("positive", F.row_number().over(by_score)).where(F.col("positive") <= positives), "positives")
        # At most `positives` rows for each of at_once anchors.
        seen = near.select("anchor_no", "positive", "score").toPandas()
        windows = (np.searchsorted(block[0], seen["anchor_no"].to_numpy(np.int64)), seen["positive"].to_numpy(np.int64), seen["score"].to_numpy(np.int64))
        far = rows.mapInArrow(_negatives(block, windows, width, primes, negatives), "anchor_no long, positive int, vec_id long, score long")
        by_score = Window.partitionBy("anchor_no", "positive").orderBy(F.desc("score"), "vec_id")
        far = far.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= negatives)
        near = near.select("anchor_no", "positive", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        named = far.join(near, ["anchor_no", "positive"]).join(anchors.where(group == g).select("anchor_no", F.col("vec_id").alias("anchor_id")), "anchor_no")
        found.append(stored(named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    if not found:
        return embeddings.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op12_hard_negatives(spark, sf_dir):
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.c, v.c) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
