"""The isolation forest against a plain walk, and the stage form on clashing columns and edge cases."""

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("public_tokenizers")

from cellcnv.llm import rules  # noqa: E402


def walked(forest, tree, row):
    """Path length of one row in one tree, node by node."""
    node, depth = 1, 0
    while forest.feature[tree, node] >= 0:
        node, depth = 2 * node + int(row[forest.feature[tree, node]] >= forest.cut[tree, node]), depth + 1
    assert forest.length[tree, node] >= depth
    return forest.length[tree, node]


def test_scores_are_mean_path_lengths_and_set_outliers_apart():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(500, 4))
    rows[:, 3] = 0.0
    forest = rules.IsolationForest(rows, n_trees=60, sample=64)
    probes = np.concatenate([rows[:20], rows[:1] + [0, 9, 0, 0], rows[:1] + [0, 0, 0, 0.5], np.zeros((1, 4))])
    expected = [2 ** (-np.mean([walked(forest, t, p) for t in range(60)]) / forest.norm) for p in probes]
    scores = forest.score(probes)
    assert np.allclose(scores, expected)
    assert scores[20] > scores[0] + 0.02 and scores[21] > scores[0] + 0.02 and scores[22] < np.median(scores[:20]) + 0.02
    assert rules.IsolationForest(rows[:2]).score(rows[:1]).shape == (1,) and forest.score(rows[:0]).shape == (0,)


def test_every_row_of_a_leaf_shares_its_path():
    rows = np.repeat(np.arange(4.0)[:, None], 3, axis=1)
    forest = rules.IsolationForest(rows, n_trees=20)
    assert (np.diff(forest.score(np.concatenate([rows, rows])).reshape(2, -1), axis=0) == 0).all()


def test_stage_form_keeps_every_column(spark):
    clean = " ".join(f"word{i % 61} and" for i in range(200)) + " some more plain words"
    texts = [clean, None, "", clean, "# | $ " * 80, "short text"]
    docs = spark.createDataFrame([(i if i else None, t, 1, "a", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, n_words int, row_ string, anomaly double")
    labels = spark.createDataFrame([(i, 1) for i in range(6)] + [(3, None)], "doc_id long, quality int")
    base_only = rules.keep_good(docs, labels.limit(0))
    assert base_only.columns == docs.columns and sorted(map(tuple, base_only.toPandas().fillna({"doc_id": -1}).text)) == sorted(map(tuple, [t for t in texts if t and not failed(t)]))
    assert rules.keep_good(docs, labels).schema == docs.schema and rules.keep_good(docs.limit(0), labels).count() == 0
    assert isinstance(rules.keep_good(docs, labels).toPandas(), pd.DataFrame)


def failed(text):
    n, *_, repeated = rules.statistics_of(text)[:5]
    return n < 50 or 100 * repeated > 50 * n
