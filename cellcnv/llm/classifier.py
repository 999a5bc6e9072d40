"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): pairwise
interactions in linear time by the sum-of-squares identity. Words enter by a hash with damped counts, scaled
to unit length per document; structure statistics come from the whole text; metadata is the row's declared
length (n_chars, where the table has it) against the real one. Training takes at most `fit_rows` labelled
rows, those lowest by a hash of their id, gathered as sparse rows; scoring runs in the tasks.

Defined results: null and empty texts are scored from the constant features; a null label is no label; with
labels of one kind only, or none, every score is the share of label 1 (0.5 without any); a null doc_id isn't
held out; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .rules import BASE, statistics_of

WORD_BITS = 15
N_STATS = 20
SCORED = "doc_id long, held_out boolean, score double, predicted int"


def features_of(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one document; words first, then statistics at the numbers after them."""
    counts = Counter(text.encode().split())
    n = len(counts)
    at, value = np.zeros(n + N_STATS, np.int32), np.zeros(n + N_STATS, np.float32)
    if n:
        mask = (1 << WORD_BITS) - 1
        at[:n] = [zlib.crc32(w) & mask for w in counts]
        damped = np.log1p(np.fromiter(counts.values(), np.float32, n))
        value[:n] = damped / np.sqrt(np.dot(damped, damped))
    base, shape = (stats := statistics_of(text))[: len(BASE)], stats[len(BASE) :]
    at[n:] = (1 << WORD_BITS) + np.arange(N_STATS)
    declared = len(text) if n_chars is None else n_chars
    rest = [
        shape[0] / 10, min(4.0, 10 * shape[1]), shape[2], shape[3], shape[4], min(4.0, 5 * shape[5]), min(4.0, 2 * shape[6]), min(4.0, 4 * shape[7]), min(4.0, 4 * shape[8]),
        shape[9] / 5, shape[10] / 2, shape[11], np.log1p(base[0]) / 10, float(shape[1] > 0.02), float(shape[4] > 0.3), float(shape[3] > 0.3), float(base[0] < 20),
        np.log1p(declared) / 10, float(declared != len(text)), 1.0,
    ]
    value[n:] = rest
    return at, value


def gathered(docs: list[tuple[str, int | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: feature numbers, values, and where each row begins."""
    rows = [features_of(t, n) for t, n in docs]
    starts = np.cumsum([0, *(len(a) for a, _ in rows)])
    return np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows]), starts


class FactorisationMachine:
    def __init__(self, rank: int = 8, seed: int = 5):
        n = (1 << WORD_BITS) + N_STATS
        rng = np.random.default_rng(seed)
        self.w0, self.w, self.v = 0.0, np.zeros(n, np.float32), rng.normal(0, 0.02, (n, rank)).astype(np.float32)
        self.constant: float | None = None

    def margin(self, at, value, starts) -> np.ndarray:
        vx = self.v[at] * value[:, None]
        begin = starts[:-1]
        sums, squares = np.add.reduceat(vx, begin, axis=0), np.add.reduceat(vx * vx, begin, axis=0).sum(1)
        return self.w0 + np.add.reduceat(self.w[at] * value, begin) + 0.5 * ((sums * sums).sum(1) - squares)

    def probability(self, at, value, starts) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(starts) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.margin(at, value, starts).astype(np.float64), -30, 30)))

    def fit(self, at, value, starts, y, epochs: int = 12, batch: int = 64, rate: float = 0.08, decay: float = 1e-4, seed: int = 5):
        """Adaptive gradient steps on the logistic loss, classes weighted alike."""
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        g0, gw, gv = 1e-6, np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(y), batch):
                rows = order[k : k + batch]
                sizes = starts[rows + 1] - starts[rows]
                own = np.cumsum([0, *sizes])
                pick = np.repeat(starts[rows] - own[:-1], sizes) + np.arange(own[-1])
                a, x = at[pick], value[pick]
                error = (weight[rows] * (self.probability(a, x, own) - y[rows]) / len(rows)).astype(np.float32)
                each = np.repeat(error, sizes)
                vx = self.v[a] * x[:, None]
                sums = np.repeat(np.add.reduceat(vx, own[:-1], axis=0), sizes, axis=0)
                grad_v = each[:, None] * (x[:, None] * (sums - vx))
                used, inverse = np.unique(a, return_inverse=True)
                dw = np.bincount(inverse, each * x, len(used)).astype(np.float32) + decay * self.w[used]
                dv = np.stack([np.bincount(inverse, g, len(used)) for g in grad_v.T], 1).astype(np.float32) + decay * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= 0.5 * rate * dv / np.sqrt(gv[used])
                d0 = float(error.sum())
                g0 += d0 * d0
                self.w0 -= rate * d0 / g0**0.5
        return self


def fold(doc_id):
    """crc32 of the id as text, modulo 3."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def _input(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), n_chars.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 5000) -> FactorisationMachine:
    """Fit on labelled rows outside the held-out fold; the sample's rows become sparse features in the tasks."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality_"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # bounded by fit_rows, so small enough to broadcast

    def featured(batches):
        for batch in batches:
            rows = [features_of(t, n) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality_"), pa.array([a for a, _ in rows], pa.list_(pa.int32())), pa.array([v for _, v in rows], pa.list_(pa.float32()))],
                ["doc_id", "quality_", "at", "value"],
            )

    rows = _input(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(featured, "doc_id long, quality_ int, at array<int>, value array<float>")
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).toArrow()
    if not sample.num_rows:
        return FactorisationMachine().fit(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(1, np.int64), np.zeros(0))
    lists = sample.column("at").combine_chunks()
    starts = np.cumsum([0, *lists.value_lengths().to_pylist()])
    at = lists.flatten().to_numpy(zero_copy_only=False)
    value = sample.column("value").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return FactorisationMachine().fit(at, value, starts, sample.column("quality_").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """Score of every whole text; the model's size is fixed by its parameters."""

    def run(batches):
        for batch in batches:
            texts_, lengths, out = batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(), []
            for k in range(0, len(texts_), 200):
                out.append(model.probability(*gathered(list(zip(texts_[k : k + 200], lengths[k : k + 200])))))
            got = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(got, pa.float64()), pa.array((got >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"]
            )

    return _input(docs).withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))).mapInArrow(run, SCORED)


def op1_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
