"""Top-k search against brute force: every edge case, many blocks with skipped postings, null and repeated ids."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from cellcnv.llm import search  # noqa: E402

TEXTS = ["", None, "   \n\t ", "one", "two words", "one two THREE", "one two three", "a b a b a b a b", "x" * 3000, " ".join(f"w{i}" for i in range(9000)), "é ñ É", "three two one tail"] + ["same words again"] * 9
SCHEMA = "doc_id long, text string, score double, query_id int"


def brute(rows, queries, k):
    counts = [Counter(search.words_of(t or "")) for _, t in rows]
    sizes, n = [sum(c.values()) for c in counts], len(rows)
    mean, df = max(1, sum(sizes) / n), Counter(w for c in counts for w in c)
    idf = {w: math.log1p((n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    out = {}
    for q, text in queries:
        scores = []
        for (d, _), c, size in zip(rows, counts, sizes):
            shared = set(search.words_of(text or "")) & c.keys()
            if shared:
                s = sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in shared)
                scores.append((-round(s, 6), -(1 << 63) if d is None else d))
        out[q] = [d for _, d in sorted(scores)[:k]]
    return out


def found(spark, rows, queries, **options):
    table = lambda r: spark.createDataFrame([(d, t, 0.5, 1) for d, t in r], SCHEMA)
    out = {}
    for r in search.search(table(rows), table(queries), **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(-(1 << 63) if r["doc_id"] is None else r["doc_id"])
    return out


@pytest.mark.parametrize("shard_docs", [4, 1000])
def test_search(spark, shard_docs):
    rows = list(enumerate(TEXTS)) + [(None, "one two"), (None, "one two"), (3, "one again")]
    expected = brute(rows, [r for r in rows if r[0] is not None and r[0] != 3], 3)
    got = found(spark, rows, [r for r in rows if r[0] != 3], k=3, shard_docs=shard_docs)
    assert got == {q: ids for q, ids in expected.items() if ids}
    empty = spark.createDataFrame([], SCHEMA)
    assert search.search(empty, empty).count() == 0


def test_words_of_every_document_are_found(spark):
    rows = [(i, "the the") for i in range(5)]
    assert found(spark, rows, [(0, "the")], k=3) == {0: [0, 1, 2]}


def test_pruning_skips_postings_and_stays_exact(monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 16)
    rng = np.random.default_rng(5)
    weights = 1 / (np.arange(3000) + 2.0)
    tongues = [[f"{tongue}{i}" for i in range(3000)] for tongue in "abcd"]
    texts = [" ".join(rng.choice(tongues[d % 4], rng.integers(5, 200), p=weights / weights.sum())) for d in range(2500)]
    texts += [texts[7] + " tail"] * 40 + ["only words of its own"]
    ids = np.arange(len(texts)) * 3 % len(texts)
    rows = list(zip(ids.tolist(), texts))
    doc, term, tf = search.term_counts(pa.array(texts))
    names, df = np.unique(term, return_counts=True)
    idf = np.log1p((len(texts) - df + 0.5) / (df + 0.5))
    index = search.ShardIndex(ids, pa.array(texts), tf.sum() / len(texts))
    assert index.n_blocks > 150
    queries = rows[::90] + rows[-2:]
    expected = brute(rows, queries, 10)
    for q, text in queries:
        terms = np.unique(search.term_counts(pa.array([text]))[1])
        got, scores = index.search(terms, idf[np.searchsorted(names, terms)], 10)
        assert got.tolist() == expected[q] and (np.diff(scores) <= 0).all()
    assert index.read < index.listed
    read = listed = 0
    for q, text in queries:
        terms = np.unique(search.term_counts(pa.array([text]))[1])
        weights = idf[np.searchsorted(names, terms)]
        _, scores = index.search(terms, weights, 10)
        index.read = index.listed = 0
        got, _ = index.search(terms, weights, 10, floor=scores[-1])
        assert got.tolist() == expected[q]
        read, listed = read + index.read, listed + index.listed
    assert read < 0.8 * listed
