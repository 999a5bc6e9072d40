"""Queries searched together, against scores of all documents: every way through the blocks, mixed floors, odd queries."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cellcnv.llm import search


def corpus(n=1500):
    rng = np.random.default_rng(8)
    weights = 1 / (np.arange(2000) + 2.0)
    tongues = [[f"{tongue}{i}" for i in range(2000)] for tongue in "abc"]
    texts = [" ".join(rng.choice(tongues[d % 3], rng.integers(1, 150), p=weights / weights.sum())) for d in range(n)]
    return texts + [texts[5]] * 20 + ["", "all its own"]


def scores_of(texts):
    """Per query text: the rounded scores of all documents; terms and weights of the queries."""
    number, term, tf = search.term_counts(pa.array(texts))
    mean = tf.sum() / len(texts)
    names, df = np.unique(term, return_counts=True)
    idf = np.log1p((len(texts) - df + 0.5) / (df + 0.5))
    impact = tf * (search.K1 + 1) / (tf + (search.K1 * (1 - search.B + search.B * np.bincount(number, tf, len(texts)) / mean))[number])
    at = np.searchsorted(names, term)

    def one(q):
        asked = np.isin(names, term[number == q])
        return names[asked], idf[asked], np.round(np.bincount(number, impact * np.where(asked, idf, 0)[at], len(texts)), 6)

    return mean, one


@pytest.mark.parametrize("options", [{}, {"COLUMNS": 0}, {"COLUMNS": 5}, {"LONG": 200, "COLUMNS": 5000}, {"SEEK": 0}, {"SEEK": 10**9}, {"BLOCK": 1000}])
def test_queries_together(monkeypatch, options):
    for name, value in ({"BLOCK": 16} | options).items():
        monkeypatch.setattr(search, name, value)
    texts, k = corpus(), 7
    ids = np.arange(len(texts)) * 7 % len(texts) - 30
    mean, one = scores_of(texts)
    index = search.ShardIndex(ids, pa.array(texts), mean)
    asked, floors, expected = [], [], []
    for j, q in enumerate([*range(0, len(texts) - 2, 12), len(texts) - 2, len(texts) - 1]):
        terms, idf, score = one(q)
        if j % 4 == 3:  # some words that no document has
            terms, idf = np.append(terms, [5, -5]), np.append(idf, [9.0, 9.0])
        best = np.lexsort((ids, -score))[:k]
        best = best[score[best] > 0]
        asked.append((terms, idf))
        floors.append([-1.0, score[best[-1]] if len(best) == k else -1.0, 0.9 * score.max() if len(terms) else -1.0][j % 3])
        expected.append([d for d in best.tolist() if score[d] > floors[-1]] if j % 3 == 2 else best.tolist())
    found = index.search_many(asked, np.array(floors), k)
    for j, ((got, _), best) in enumerate(zip(found, expected)):
        assert got.tolist()[: len(best)] == ids[best].tolist()
        if j % 3 < 2:
            assert len(got) == len(best)
    assert not index.weight.any()
    assert index.search_many([], np.zeros(0), k) == []


@pytest.mark.parametrize("most_terms", [None, 300, 1])
def test_a_shard_reads_its_columns_for_many_queries_at_once(monkeypatch, tmp_path, most_terms):
    def alone(*args, **options):
        raise AssertionError("a query was searched on its own")

    texts, k = corpus(600), 5
    mean, one = scores_of(texts)
    queries = [(q, *one(q)) for q in range(0, 600, 2)]
    table = {"query_id": [q[0] for q in queries], "terms": [q[1] for q in queries], "idf": [q[2] for q in queries], "floor": [-1.0] * len(queries)}
    pq.write_table(pa.table(table), tmp_path / "part.parquet")
    monkeypatch.setattr(search.ShardIndex, "search", alone)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    if most_terms:
        monkeypatch.setattr(search, "QUERY_TERMS", most_terms)
    together = []
    many = search.ShardIndex.search_many
    monkeypatch.setattr(search.ShardIndex, "search_many", lambda self, asked, *rest: together.append([len(t) for t, _ in asked]) or many(self, asked, *rest))
    run = search.shard_search(str(tmp_path), k, mean, 10_000, 1 << 24)
    (hits,) = run([batch])
    assert sum(map(len, together)) == len(queries)
    assert len(together) == 1 if not most_terms else all(len(n) == 1 or sum(n) <= 2 * most_terms for n in together)
    found = {}
    for q, d in zip(hits["query_id"].to_pylist(), hits["doc_id"].to_pylist()):
        found.setdefault(q, []).append(d)
    assert found == {q: [d for d in np.lexsort((np.arange(len(texts)), -score))[:k].tolist() if score[d] > 0] for q, _, _, score in queries}


@pytest.mark.parametrize("shard_docs", [3, 40, 1000])
def test_searched_in_several_steps(spark, shard_docs):
    texts, k = corpus(450), 4
    _, one = scores_of(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in search.search(rows, rows.where("doc_id % 5 = 0"), k=k, shard_docs=shard_docs).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["doc_id"])
    for q in range(0, len(texts), 5):
        score = one(q)[2]
        assert found.get(q, []) == [d for d in np.lexsort((np.arange(len(texts)), -score))[:k].tolist() if score[d] > 0]
