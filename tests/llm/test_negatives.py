"""Hard negatives against plain Python integers."""

import math

import numpy as np
import pytest

from cellcnv.llm.negatives import exact_products, hard_negatives, primes_for, residues

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def plain(rows, every=100):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], (c + 1) % 10 if i % 7 == 0 else c) for i, v, c, _ in rows if i is not None and v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for anchor, v, label in kept:
        if anchor % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, c) for i, w, c in kept if i != anchor)
        for score, i, _ in [s for s in scored if s[2] == label][:5]:
            inside = [s for s in scored if s[2] != label and 80 * -score <= 100 * -s[0] <= 100 * -score][:5]
            out += [(anchor, i, k + 1, j, -score, -other) for k, (other, j, _) in enumerate(inside)]
    return sorted(out)


def mined(spark, rows, **how):
    return sorted(map(tuple, hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), **how).collect()))


def vectors(n, width, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=width)
    return [(i, [float(x) for x in (centre + rng.normal(size=width) * 2).astype(np.float32) * spread], int(rng.integers(0, 4)), "x") for i in range(n)]


def test_products_are_exact_for_any_signs_and_widths():
    rng = np.random.default_rng(1)
    for width, largest in ((3, 5), (64, 256), (200, 40_000)):
        a, b = (rng.integers(-largest, largest + 1, (n, width)) for n in (7, 9))
        a[0], b[0], b[1] = largest, largest, -largest
        primes = primes_for(float(width * largest**2))
        assert (exact_products(residues(a, primes), residues(b, primes), primes) == a @ b.T).all()
    assert len(primes) > 3


def test_equals_plain_integers(spark):
    rows = vectors(260, 5, 2)
    want = plain(rows, 20)
    assert want and mined(spark, rows, anchor_every=20) == want
    assert mined(spark, rows, anchor_every=20, at_once=4) == want


def test_ties_repeats_nulls_and_a_hot_vector(spark):
    rows = vectors(60, 3, 3)
    rows += [(100 + i, [1.0, 1.0, 1.0], i % 3, None) for i in range(120)]  # one vector in two thirds of the rows
    rows += [(400, None, 1, "x"), (401, [1.0, None, 1.0], 1, "x"), (402, [1.0, float("nan"), 1.0], 1, "x"), (403, [1.0, float("inf"), 1.0], 1, "x"), (404, [1.0] * 3, None, "x"), (None, [1.0] * 3, 1, "x")]
    rows += [(200, [2.0, 0.5, 1.0], 2, "x"), (150, [1.0, 1.0, 1.0], 1, "x"), (500, [-1.0, -1.0, -1.0], 1, "x")]
    want = plain(rows)
    assert want and mined(spark, rows) == want


def test_empty_short_and_huge_vectors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [], 1, "x"), (1, [], 2, "x"), (2, [], 1, "x"), (3, [1.0], 2, "x")]) == [(0, 1, 1, 2, 0, 0), (0, 3, 1, 2, 0, 0)]  # 0 is divisible by 7: its label is 2
    with pytest.raises(ValueError, match="2\\^46"):
        mined(spark, [(0, [1e30], 1, "x")])
