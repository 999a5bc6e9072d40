"""Suffix deduplication: repeated ids, and transforms of many shards, against brute force."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from cellcnv.llm import suffixes  # noqa: E402

PART = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(300))
OTHER = "".join(chr(65 + (i * i * 5 + i // 7) % 26) for i in range(300))
SCHEMA = "doc_id long, text string, doc_ string, text_ int"


def brute(rows, length=100):
    """A byte goes if a window over it starts at a smaller id, or earlier in the same text of the same id."""
    data = [(-(1 << 63) if d is None else d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, t in data:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, t in data:
        gone, seen = np.zeros(len(t), bool), set()
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if least[w] < d or w in seen:
                gone[p : p + length] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def found(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    out = suffixes.without_repeats(docs).withColumn("sha", F.sha2("kept", 256)).collect()
    return sorted((-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]) for r in out)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeated_ids(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_SNIPPETS", hot)
    rows = [
        (1, PART), (2, PART), (2, OTHER), (3, OTHER + "x" + PART[:150]), (3, "y" + PART[50:] + OTHER[20:]), (3, "y" + PART[50:] + OTHER[20:]),
        (5, "z" * 250 + PART[:99]), (5, "q" + "z" * 180), (None, "n" + OTHER[100:] + "m" + OTHER[100:]), (None, OTHER[90:] + "k"), (None, None), (None, ""), (9, None), (9, OTHER[:100]),
    ]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_many_shards_and_buckets(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_SNIPPETS", hot)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 400)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 20_000)
    rng = np.random.default_rng(4)
    parts = ["".join(rng.choice(list("abcde "), 220)) for _ in range(6)]
    rows = []
    for i in range(90):
        p = parts[rng.integers(6)]
        a = int(rng.integers(0, 100))
        rows.append((i, "".join(rng.choice(list("abcde "), rng.integers(0, 40))) + p[a : a + int(rng.integers(90, 220))] + "".join(rng.choice(list("xyz"), rng.integers(0, 30)))))
    assert found(spark, rows) == brute(rows)


def test_merged_transforms_equal_one_search():
    rng = np.random.default_rng(8)
    for shard_bytes in (50, 400, 1 << 20):
        strings = [bytes(rng.choice(list(b"ab"), rng.integers(12, 60)).astype(np.uint8)) for _ in range(80)]
        windows = np.array([len(s) - 11 for s in strings])
        doc, text, lo = rng.integers(0, 20, 80), rng.integers(0, 3, 80), np.arange(80) * 100
        before = suffixes.SHARD_BYTES
        suffixes.SHARD_BYTES = shard_bytes
        try:
            later = suffixes.repeated_windows(strings, windows, doc, text, lo, 12)
        finally:
            suffixes.SHARD_BYTES = before
        places = [(s[o : o + 12], int(d), int(t), int(a) + o) for s, d, t, a in zip(strings, doc, text, lo) for o in range(len(s) - 11)]
        assert later.tolist() == [any(w == v and (e < d or (e == d and u == t and q < p)) for v, e, u, q in places) for w, d, t, p in places]
