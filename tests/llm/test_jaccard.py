"""The n-gram Jaccard join against a comparison of all pairs."""

import random
import re

from cellcnv.llm import jaccard
from cellcnv.llm.jaccard import shingle_hashes, similar_texts

SCHEMA = "doc_id long, text string, node string"


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return sorted(((i, len(s), low.get(find(k))) for k, ((i, _, _), s) in enumerate(zip(rows, sets))), key=str)


def joined(spark, rows, **how):
    return sorted(map(tuple, similar_texts(spark.createDataFrame(rows, SCHEMA).repartition(3), **how).collect()), key=str)


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passages = [rng.choices(words, k=rng.randint(20, 60)) for _ in range(6)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.5:  # an edited copy, near the border of 0.8 on either side
            new = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                new[rng.randrange(len(new))] = rng.choice(words)
        elif kind < 0.8:  # mostly of passages that others hold as well
            new = sum(rng.sample(passages, rng.randint(1, 3)), []) + rng.choices(words, k=rng.randint(0, 8))
        else:
            new = rng.choices(words, k=rng.randint(1, 80))
        texts.append(" ".join(new))
    return [(k, t, "x") for k, t in enumerate(texts)]


def test_hashes_are_of_the_distinct_shingles():
    for _, text, _ in corpus(3, 60):
        assert len(shingle_hashes(text)) == len(shingles(text))
    assert len(shingle_hashes("A b\tc\nd E")) == 1 and (shingle_hashes("A b\tc\nd E") == shingle_hashes("a B c D e")).all()
    assert shingle_hashes("a b")[0] != shingle_hashes("b a")[0] != shingle_hashes("ab")[0]


def test_equals_all_pairs(spark):
    rows = corpus(4)
    want = plain(rows)
    assert 10 < len({c for _, _, c in want}) < 140
    assert joined(spark, rows, small=1) == want


def test_one_hot_passage_and_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PIECE_ROWS", 7)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base), "x") for k in range(30)]
    rows += [(100 + k, " ".join(base[:-1] + [f"end{k}"]), "x") for k in range(60)]  # near the base, and each other
    rows += [(300 + k, " ".join(base[:50] + [f"own{k}_{j}" for j in range(12)]), "x") for k in range(40)]  # share a passage, aren't similar
    rows += [(500 + k, " ".join(rng.sample(base, 30)), "x") for k in range(20)]
    assert joined(spark, rows) == plain(rows)


def test_nulls_empties_repeats_and_long_texts(spark):
    long = " ".join(f"v{k * k % 9973}" for k in range(60_000))
    rows = [(1, None, None), (2, "", "b"), (3, " \t\n", "c"), (4, "one two", "d"), (5, "ONE two", "e"), (6, "two one", None), (None, "one  two", "f"), (None, "alone", "g"), (7, "one two three four five", "h")]
    rows += [(8, long, "x"), (9, long + " end", "y"), (8, long, "x"), (8, "other text under the same id as before", "z"), (-3, "élan vital", "ä"), (-2, "Élan vital", "ä")]
    assert joined(spark, rows) == plain(rows)
    assert joined(spark, []) == []
