"""Quality rules: an isolation forest over rule statistics.

Every whole text is reduced to a row of rule statistics. A forest of random splits is grown on a bounded,
documented sample of rows that are labelled good; documents that few splits set apart (short path lengths)
are anomalous. The threshold on the anomaly score is calibrated on all labelled rows: among the thresholds
that keep at least `keep` of the rows labelled good, the one that best separates the labels.

Defined results: null and empty texts have zero in every statistic and fail the base rules; repeated rows
are judged each; without any labelled row only the base rules decide; extra columns are ignored by the
query form and passed on by the stage form.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table, texts

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHAPE = ["mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "punctuation", "marks", "bars", "line_words", "distinct", "short_words"]
STATS = ", ".join(["doc_id long", *(f"{c} long" for c in BASE), *(f"{c} double" for c in SHAPE)])
SYMBOLS = b"#*$%&|<>"
#: How far cuts reach beyond a node's rows, and the least width of a feature.
WIDER, FLAT = 0.5, 0.002


def _classes() -> np.ndarray:
    """Byte classes as columns of a 256-row matrix: symbol, upper, lower, digit, punctuation, '!'/'?', '|', space, first byte of a character."""
    b = np.arange(256)
    chars = [chr(i) for i in range(256)]
    member = lambda test: np.array([i < 128 and bool(test(chars[i])) for i in range(256)])
    columns = [
        np.isin(b, list(SYMBOLS)), member(str.isupper), member(str.islower), member(str.isdigit),
        member(lambda c: c.isprintable() and not c.isalnum() and c != " "), np.isin(b, list(b"!?")), b == ord("|"), np.isin(b, [32, *range(9, 14)]), (b & 0xC0) != 0x80,
    ]
    return np.stack(columns, axis=1).astype(np.int64)


CLASSES = _classes()


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside 3-word windows that occur at least twice, and the number of distinct words."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    n = len(number)
    if len(ids) < 4:
        return 0, n
    windows = (ids[:-2] * n + ids[1:-1]) * n + ids[2:] if n < 2_000_000 else np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].ravel()
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0, n
    hit = np.isin(windows, twice)
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum()), n


def dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and the number of lines with a word."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines)), len(lines)


def statistics_of(text: str) -> tuple:
    data = text.encode()
    words = data.split()
    if not words:
        return (0,) * len(BASE) + (0.0,) * len(SHAPE)
    symbols, upper, lower, digits, punctuation, marks, bars, spaces, chars = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ CLASSES).tolist()
    repeated, distinct = repeat_words(words)
    dup, n_lines = dup_lines(data)
    n, word_chars = len(words), chars - spaces
    short = sum([len(w) < 4 for w in words])
    return (
        n, word_chars, symbols, dup, repeated,
        word_chars / n, symbols / word_chars, dup / n_lines, repeated / n, upper / max(1, upper + lower), digits / word_chars, punctuation / n,
        marks / n, bars / n, float(np.log1p(n / n_lines)), distinct / n ** 0.8, short / n,
    )


def _statistics(batches):
    for batch in batches:
        rows = [statistics_of(t) for t in batch.column("text").to_pylist()]
        columns = list(zip(*rows)) or [()] * (len(BASE) + len(SHAPE))
        kinds = [pa.int64()] * len(BASE) + [pa.float64()] * len(SHAPE)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *BASE, *SHAPE])


def rule_statistics(docs: DataFrame) -> DataFrame:
    """The base counts and shape statistics of every whole text."""
    return texts(docs).mapInArrow(_statistics, STATS)


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


class IsolationForest:
    """Random split trees as flat arrays; all trees have the same depth limit.

    A node cuts one feature at a random place of the range of its rows, widened on both sides by WIDER of its width,
    so that cuts also fall where no row of the sample lies and set apart rows that come from there. A width counts
    as `least` of the feature at least: half its deviation over all rows, and FLAT for features that are all equal.
    """

    def __init__(self, rows: np.ndarray, n_trees: int = 150, sample: int = 256, seed: int = 11):
        rng = np.random.default_rng(seed)
        sample = min(sample, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(2, sample)))))
        size = 2 ** (self.depth + 1)
        self.feature, self.cut, self.length = np.full((n_trees, size), -1), np.zeros((n_trees, size)), np.zeros((n_trees, size))
        self.norm = self._expected(sample) or 1.0
        self.least = np.maximum(0.5 * rows.std(0), FLAT)
        for t in range(n_trees):
            self._grow(t, 1, 0, rows[rng.choice(len(rows), sample, replace=False)], rng)

    @staticmethod
    def _expected(n: int) -> float:
        """Mean path length of an unsuccessful search in a random binary tree of n rows."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def _grow(self, t, node, depth, rows, rng):
        if depth == self.depth or len(rows) < 2:
            self.length[t, node] = depth + self._expected(len(rows))
            return
        f = rng.integers(rows.shape[1])
        low, high = rows[:, f].min(), rows[:, f].max()
        margin = WIDER * max(high - low, self.least[f])
        cut = rng.uniform(low - margin, high + margin)
        self.feature[t, node], self.cut[t, node] = f, cut
        left = rows[:, f] < cut
        self._grow(t, 2 * node, depth + 1, rows[left], rng)
        self._grow(t, 2 * node + 1, depth + 1, rows[~left], rng)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score of each row, 0 to 1: the shorter the paths, the higher."""
        if not len(rows):
            return np.zeros(0)
        total, at_row = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, length in zip(self.feature, self.cut, self.length):
            node = np.ones(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, 2 * node + (rows[at_row, np.maximum(f, 0)] >= cut[node]), node)
            total += length[node]
        return 2.0 ** (-(total / len(self.feature)) / self.norm)


def score_with(forest: IsolationForest, *columns) -> Column:
    """Anomaly score, rounded to 4 digits, of the shape statistics."""

    @F.pandas_udf("double")
    def scored(shape: pd.DataFrame) -> pd.Series:
        return pd.Series(np.round(forest.score(shape.to_numpy(np.float64)), 4))

    return scored(F.struct(*columns))


def fit(stats: DataFrame, labels: DataFrame, sample: int = 8192, keep: float = 0.995) -> tuple[IsolationForest | None, float]:
    """Forest and threshold.

    The forest is grown on at most `sample` rows with quality 1, those lowest by a hash of their id. The
    threshold comes from counts by score of all labelled rows that pass the base rules.
    """
    good = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality_"))
    known = stats.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).join(good, "doc_id")
    rows = known.where("quality_ = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(*SHAPE).toPandas().to_numpy(np.float64)
    if len(rows) < 2:
        return None, 1.0
    forest = IsolationForest(rows)
    counts = known.select(score_with(forest, *SHAPE).alias("score_"), "quality_").groupBy("score_").agg(F.sum(F.col("quality_").cast("long")).alias("good"), F.count("*").alias("n"))
    counts = counts.toPandas().sort_values("score_", ignore_index=True)  # at most 10,001 rows: scores have 4 digits
    kept_good = counts["good"].cumsum() / max(1, counts["good"].sum())
    bad = counts["n"] - counts["good"]
    cut_bad = 1 - bad.cumsum() / max(1, bad.sum())
    allowed = kept_good >= keep
    gain = (kept_good + cut_bad).where(allowed, -1.0)
    return forest, float(counts["score_"][int(gain.to_numpy().argmax())])


def judged(stats: DataFrame, forest: IsolationForest | None, threshold: float) -> DataFrame:
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    out = stats.withColumn("base_failed", failed).withColumn("anomaly", score_with(forest, *SHAPE) if forest else F.lit(0.0))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= threshold))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict of every document."""
    stats = stored(rule_statistics(docs), "rule-stats")
    return judged(stats, *fit(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    Statistics are taken a second time for the verdict, as a stored copy of the texts beside them would be larger than all else.
    """
    forest, threshold = fit(stored(rule_statistics(docs), "rule-stats"), labels)

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        rows = [statistics_of(t or "") for t in text]
        base, shape = np.array([r[: len(BASE)] for r in rows]).reshape(-1, len(BASE)), np.array([r[len(BASE) :] for r in rows], np.float64).reshape(-1, len(SHAPE))
        ok = ~base_failed(base[:, 0], base[:, 4])
        return pd.Series(ok & (np.round(forest.score(shape), 4) <= threshold) if forest else ok)

    return docs.where(good("text"))


def op5_quality_rules(spark, sf_dir):
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *BASE, "base_failed", "kept", "anomaly")
