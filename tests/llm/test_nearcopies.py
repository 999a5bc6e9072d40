"""The near-duplicate stage of the pipeline against brute force over all pairs."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from cellcnv.llm import nearcopies  # noqa: E402
from cellcnv.llm.common import table  # noqa: E402


def brute(texts):
    """Components of five-word Jaccard >= 0.8, as the smallest position of each text's component."""
    def cut(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [cut(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) * 9 >= 4 * (len(a) + len(sets[j])):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def texts_of(rng):
    """Clean texts, near-copies at many distances, a large group that meets at one passage, short and wordless texts."""
    word = lambda: f"w{rng.randrange(5000)}"
    out = [None, "", " \n", "one", "ONE", "two words", "a b c d e", "a b c d e f"]
    for _ in range(40):
        t = [word() for _ in range(rng.randrange(30, 200))]
        out.append(" ".join(t))
        for edits in range(1, 6):
            u = list(t)
            for _ in range(edits):
                u[rng.randrange(len(u))] = word()
            out.append(" ".join(u))
    passage = [word() for _ in range(60)]
    for k in range(60):
        u = passage + [word() for _ in range(k // 2)]
        u[rng.randrange(60)] = word()
        out.append(" ".join(u))
    rng.shuffle(out)
    return out


SCHEMA = "doc_id long, text string, source string"


@pytest.mark.parametrize("small", [8, 1])
def test_stage_equals_brute_force(spark, small):
    texts = texts_of(random.Random(5))
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    stay = {r["doc_id"] for r in nearcopies.one_of_near_copies(docs, small).collect()}
    assert stay == set(brute(texts)) and len(stay) < len(texts)


def test_stage_reaches_all_pairs_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    ids = [r["doc_id"] for r in docs.orderBy("doc_id").collect()]
    out = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(ids[i] for i in set(brute(texts)))


def test_stage_with_repeated_ids(spark):
    rows = [(1, "some words that are here for all to see", "a"), (1, "some words that are here for all to see", "b"), (1, "quite another text under the same id as those", "c"), (None, "quite another text under the same id as those", "d")]
    out = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r["doc_id"] for r in out) == [1, 1] and {r["text"] for r in out} == {rows[0][1], rows[2][1]}
    assert corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_close_fingerprints_are_compared_first(spark, monkeypatch):
    """Close fingerprints give pairs of unlike sets too: these are refused, and the others need no further pair."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    texts = [" ".join(base)] + [" ".join(base[:-1] + [f"end{k}"]) for k in range(30)] + [" ".join(base[:200] + [f"o{rng.randrange(900)}" for _ in range(200)])]
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], SCHEMA)
    asked = []
    first = nearcopies.close_prints
    monkeypatch.setattr(nearcopies, "close_prints", lambda *x: asked.append(first(*x).collect()) or first(*x))
    assert sorted(r["doc_id"] for r in nearcopies.one_of_near_copies(docs).collect()) == [0, 31]
    assert len(asked[0]) > 20 and all(r["a"] < r["b"] for r in asked[0])
