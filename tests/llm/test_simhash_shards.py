"""Trees inside shards: the links connect the same points as a comparison of all; null and repeated ids in components."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from cellcnv.llm import simhash  # noqa: E402


def components(points, links):
    root = {int(p): int(p) for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(int(a)), find(int(b))
        root[max(a, b)] = min(a, b)
    return {p: find(p) for p in root}


@pytest.mark.parametrize("most", [40, 300])
def test_links_within_a_large_shard(most):
    rng = np.random.default_rng(6)
    points = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    near = points[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    chain = near[:100] ^ np.uint64(0b11 << 20)
    points = np.unique(np.concatenate([points, near, chain, np.arange(70).astype(np.uint64)]))
    rng.shuffle(points)
    home = np.ones(len(points), bool)
    links = simhash.links_within(points, home, 2, most)
    assert all(bin(int(a) ^ int(b)).count("1") <= 2 for a, b in links)
    assert components(points, links) == components(points, simhash.spanning_links(points, home, 2))
    home = rng.random(len(points)) < 0.4
    links = components(points, simhash.links_within(points, home, 2, most))
    for p in points[home]:
        for q in points[np.bitwise_count(points ^ p) <= 2]:
            assert links[int(p)] == links[int(q)]


def test_null_and_repeated_ids(spark):
    rows = [(None, "alone and without an id"), (None, "a shared text of words"), (4, "a shared text of words"), (4, "another text that is not like it"), (2, "a shared text of words"), (9, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(None, None), (None, 2), (4, 2), (4, 4), (2, 2), (9, 8), (8, 8)], key=str)
