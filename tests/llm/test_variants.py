"""Spelling variants against a plain version that compares all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from cellcnv.llm.variants import one_error, spelling_variants

SCHEMA = "doc_id long, text string, word string"


def apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows):
    seen = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in words if apart(w, x)] for w in words}
    form = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: f for w, f in form.items() if words[f] >= 2 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def found(spark, rows, **sizes):
    got = spelling_variants(spark.createDataFrame(rows, SCHEMA).repartition(3), **sizes).collect()
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got)


def key(rows):
    return sorted(rows, key=lambda r: r[0])


def test_search_finds_every_pair_with_an_equal_end():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(300)})
    for exact in (0, 1, 3):
        searches = [w for w in words if len(w) >= exact]
        want = {(w, x) for w in searches for x in words if apart(w, x) and (not exact or len(x) >= exact and x[-exact:] == w[-exact:] and apart(w[:-exact], x[:-exact]))}
        assert {(searches[q], words[t]) for q, t in zip(*one_error(words, searches, [exact] * len(searches)))} == want


@pytest.mark.parametrize("sizes", [{}, {"half_words": 3, "shard_words": 10}])
def test_equals_all_pairs(spark, sizes):
    rng = random.Random(2)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(120)]
    rows = [(k, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(120)], k=40)), "x") for k in range(100)]
    want = plain(rows)
    assert any(r[1] for r in want) and any(r[2] != r[1] for r in want if r[1])
    assert key(found(spark, rows, **sizes)) == key(want)


def test_capitals_accents_nulls_repeats_and_long_words(spark):
    long = "x" * 3000
    rows = [(1, "HOUSE House house École École École école école école école école école", "a"), (1, "hause hause hause", "a"), (2, None, "b"), (None, "house house house mouse mouse mouse", None), (3, "", "c")]
    rows += [(4, "house", "d")] * 3 + [(5, f"{long} {long}y {long}y", None)] * 3
    assert key(found(spark, rows)) == key(plain(rows))
    assert {r[0]: r[1] for r in found(spark, rows)}["hause"] == "house"


def test_no_words(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, "one two", "x"), (2, None, None)]) == []
