"""Null ids, texts of a megabyte, and the fitted parts of the span finder against numpy."""

import hashlib
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from cellcnv.llm import bpe, classifier, pii, rules, suffixes, templates, warc  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def megabyte(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghiéß") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    lines = [" ".join(rng.choices(words, k=12)) for _ in range(15_000)]
    return "\n".join(lines)


@pytest.fixture(scope="module")
def rows():
    long = megabyte(1)
    return [(1, long, "de", "a", 5), (2, long, "de", "a", 5), (None, "no id here but some words of text", None, None, None), (None, None, None, None, None), (3, "Call +49 30 1234567 now", "en", "b", 23)]


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(1, 4)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality_score_of_long_texts_and_null_ids(docs, labels):
    found = classifier.score(docs, classifier.train(docs, labels)).collect()
    assert len(found) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert [r["held_out"] for r in found if r["doc_id"] is None] == [False, False]
    assert len({r["score"] for r in found if r["doc_id"] in (1, 2)}) == 1


def test_rule_statistics_of_long_texts_and_null_ids(docs, labels, rows):
    found = rules.quality_rules(docs, labels).collect()
    assert len(found) == 5 and sum(r["doc_id"] is None for r in found) == 2
    words, lines = rows[0][1].split(), rows[0][1].split("\n")
    long = next(r for r in found if r["doc_id"] == 1)
    assert (long["n_words"], long["word_chars"], long["n_dup_lines"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)))
    assert all(r["base_failed"] and not r["kept"] for r in found if r["n_words"] < 50)


def test_long_texts_and_null_ids_are_encoded_and_decoded(docs, rows):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    found = sorted(map(tuple, bpe.encode_documents(docs, path, P.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        ids = plain.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(want, key=str)


def test_a_long_copy_is_removed_whole(docs, rows):
    size = len(rows[0][1].encode())
    found = {r["doc_id"]: r for r in suffixes.without_repeats(docs.where("doc_id < 3")).collect()}
    assert found[1]["n_removed"] < size // 100 and (found[2]["n_bytes"], found[2]["n_removed"], found[2]["n_spans"]) == (size, size, 1)


def test_lines_recur_across_long_texts_and_null_ids(spark):
    line, other = "this line stands in every document here", "and this one only here in one"
    texts = [(None, f"{line}\n{other} a"), (None, line), (7, f"{megabyte(2)}\n{line}"), (8, None)]
    found = templates.without_recurring_lines(spark.createDataFrame(texts, "doc_id long, text string"), counts=True).collect()
    assert len(found) == 4 and sum(line in (r["text"] or "") for r in found) == 1
    assert sum(r["n_lines_"] for r in found) == 2 + 1 + 15_001 + 1


def test_null_page_ids_and_repeats_of_the_largest(spark):
    pages = spark.createDataFrame([(None, "u", "<p>same</p>"), (5, "u", "<p>same</p>"), (5, "v", "<p>same</p>"), (3, "w", "<p>same</p>"), (None, "x", "alone"), (9, None, None)], "page_id long, url string, html string")
    path = warc.fresh_path(spark, "warc-test")
    warc.write_pages(pages, path)
    found = sorted((str(r["record_id"]), r["record_type"], str(r["refers_to"])) for r in warc.read_warc(spark, path, verify="true").collect())
    assert len(found) == 6
    assert found.count(("5", "response", "None")) == 2 and ("3", "revisit", "5") in found and ("9", "response", "None") in found
    assert sorted(f[1] for f in found if f[0] in ("None", "")) == ["response", "revisit"]


def test_spans_of_null_ids(docs):
    found = pii.find(docs.where("doc_id IS NULL OR doc_id = 3")).collect()
    assert sorted(r["n_phone"] for r in found) == [0, 0, 1] and sum(r["doc_id"] is None for r in found) == 2


def drawn(n=60, seed=3):
    """Counts by (kind, votes, size): labelers that are mostly right, over spans that are real by half."""
    rng = np.random.default_rng(seed)
    counted = {}
    for _ in range(4000):
        kind, real, size = int(rng.integers(0, 3)), rng.random() < 0.5, int(rng.integers(0, 4))
        votes = [int(rng.choice(3, p=[0.2, 0.2, 0.6] if real else [0.6, 0.3, 0.1])) for _ in range(pii.N_LABELERS)]
        key = kind, sum(v * 3**i for i, v in enumerate(votes)), size
        counted[key] = counted.get(key, 0) + 1
    return sorted((*k, c) for k, c in counted.items())


def em_by_arrays(rows, rounds=60):
    """Expectation-maximisation over arrays: rows of kinds, votes (one-hot) and counts."""
    kinds = np.array([k for k, _, _ in rows])
    votes = np.eye(3)[np.array([pii.votes_of(p) for _, p, _ in rows])]
    n = np.array([c for *_, c in rows], float)
    theta = np.tile([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]], (pii.N_LABELERS, 1, 1))
    prior = np.full(kinds.max() + 1, 0.5)
    for _ in range(rounds):
        logs = np.einsum("rlv,lyv->ry", votes, np.log(theta)) + np.log(np.stack([1 - prior[kinds], prior[kinds]], axis=1))
        p = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        weight = np.stack([(1 - p) * n, p * n], axis=1)
        seen = np.einsum("ry,rlv->lyv", weight, votes) + [[6, 3, 1], [1, 3, 6]]
        theta = seen / seen.sum(axis=2, keepdims=True)
        prior = np.clip((np.bincount(kinds, p * n) + 1) / (np.bincount(kinds, n) + 2), 0.001, 0.999)
    return theta, p


def test_reliabilities_and_classifier_equal_array_versions():
    rows = drawn()
    merged = {}
    for k, votes, _, n in rows:
        merged[k, votes] = merged.get((k, votes), 0) + n
    merged = [(k, v, n) for (k, v), n in merged.items()]
    theta, posterior = pii.reliabilities(merged)
    want_theta, want = em_by_arrays(merged)
    assert np.allclose(theta, want_theta) and np.allclose([posterior[k, v] for k, v, _ in merged], want)
    assert (np.array(theta)[:, 1, 2] > 0.4).all() and (np.array(theta)[:, 0, 0] > 0.4).all()
    features = np.zeros((len(rows), 1 + len(pii.KINDS) + 3 * pii.N_LABELERS + 4))
    for r, (k, votes, size, _) in enumerate(rows):
        features[r, pii.indicators(k, votes, size)] = 1
    share = np.log1p([n for *_, n in rows])
    share /= share.sum()
    target = np.array([posterior[k, v] for k, v, *_ in rows])
    w = np.zeros(features.shape[1])
    for _ in range(400):
        w = w - (1e-3 * w + features.T @ (share * (1 / (1 + np.exp(-features @ w)) - target)))
    assert np.allclose(pii.span_classifier(rows), w)
    assert ((features @ w > 0) == (target > 0.5)).mean() > 0.9
