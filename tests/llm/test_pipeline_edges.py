"""The pipeline's stages on nulls, repeats, clashing columns, a long text and an empty table."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from cellcnv.llm.common import stored  # noqa: E402

NAMES = ["row_", "spans_", "pii_text", "pii_all", "node", "fp", "kept", "n_words", "whole_", "dealt", "at_"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)


@pytest.fixture
def rows():
    def words(seed, n=150):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randrange(2, 8))) for _ in range(n))

    texts = [
        (1, None), (2, ""), (None, words(3) + "\nmail me at some.one@site.org today"), (4, words(5)), (4, words(5)), (5, words(7) + "\npassword=hunter22"), (6, words(11)), (7, words(11).replace(" ", "\n", 1)),
        (8, "\n".join(words(100 + i, 900) for i in range(60))), (None, None),
    ]
    return [(d, t, "en", "s", len(t or ""), *(["z"] * len(NAMES))) for d, t in texts]


def test_stages_on_edge_cases(spark, rows, tmp_path):
    spark.createDataFrame([(d, 1, 0) for d in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, left = spark.createDataFrame(rows, SCHEMA), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
        left.append(sorted((r["doc_id"] or 0) for r in docs.collect()))
    assert set(left[0]) >= {0, 4, 5, 6, 7, 8} and left[0].count(4) == 2 and 1 not in left[0] and 2 not in left[0]
    assert left[1] == left[0] and left[2].count(4) == 1 and (6 in left[2]) != (7 in left[2]) and left[3] == left[2]
    out = {r["doc_id"]: r for r in docs.collect()}
    assert all(out[d][n] == "z" for d in out for n in NAMES) and all(r["n_chars"] == len(r["text"]) for r in out.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == len(out)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
