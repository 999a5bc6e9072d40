"""Cursors in long lists, against scores of all documents."""

import numpy as np
import pyarrow as pa
import pytest

from cellcnv.llm import search


@pytest.mark.parametrize("columns", [512, 3, 0])
def test_long_lists_are_read_at_possible_pivots(monkeypatch, columns):
    monkeypatch.setattr(search, "COLUMNS", columns, raising=False)
    rng = np.random.default_rng(3)
    n, k = 2000, 5
    common = [f"c{j}" for j in range(40)]
    texts = [" ".join([*(c for j, c in enumerate(common) if rng.random() < 0.9 - j / 60), *(f"r{int(x)}" for x in rng.zipf(1.3, 30) % 5000)]) for _ in range(n)]
    ids = np.arange(n) * 3 - 100
    number, term, tf = search.term_counts(pa.array(texts))
    mean = tf.sum() / n
    index = search.ShardIndex(ids, pa.array(texts), mean)
    names, df = np.unique(term, return_counts=True)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    impact = tf * (search.K1 + 1) / (tf + (search.K1 * (1 - search.B + search.B * np.bincount(number, tf, n) / mean))[number])
    for q in range(0, n, 40):
        asked = np.isin(names, term[number == q])
        score = np.round(np.bincount(number, impact * np.where(asked, idf, 0)[np.searchsorted(names, term)], n), 6)
        best = np.lexsort((ids, -score))[:k]
        for floor in (-1.0, score[best[-1]]):
            if floor < 0:
                before = index.read
            got, scores = index.search(names[asked], idf[asked], k, floor)
            assert got.tolist() == ids[best].tolist() and np.allclose(scores, score[best], atol=2e-6)
            if floor < 0:
                index.listed, index.read = index.listed - sum(df[asked]), before
    assert not index.weight.any()
    if columns == 512:
        assert index.read < 0.25 * index.listed, (index.read, index.listed)
