"""The line stage of the pipeline: several templates in a leaf, and lines judged as they stand."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id long, text string"


def left(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}


def test_templates_that_share_a_leaf(spark):
    rng = random.Random(2)
    forms = ["see the page about red apples and green {} today", "see the page where old ships sail past {} islands", "see the page which nobody wrote because {} was late"]
    lines = [f.format(f"v{chr(97 + k)}{chr(97 + j)}") for k, f in enumerate(forms) for j in range(10)]
    noise = ["see the page " + " ".join("".join(rng.choice("bcdfgklm") for _ in range(7)) for _ in range(7)) for _ in range(40)]
    texts = lines + noise
    rng.shuffle(texts)
    out = left(spark, texts)
    assert sum(t in lines for t in out.values()) == 3 and sum(t in noise for t in out.values()) == 40


def test_lines_judged_as_they_stand(spark):
    digits, other = "2024-01-02 13:45 77.5 99.1 ab12cd", "2024-01-03 13:46 77.6 99.2 ab12cd"
    script = "这是一个没有空格的很长的段落它在许多文件里一字不差地重复出现"
    out = left(spark, [f"{digits}\nYes.\none", f"{script}\nYes.\ntwo", f"{digits}\n{script}\nthree", other])
    assert out == {0: f"{digits}\nYes.\none", 1: f"{script}\nYes.\ntwo", 2: "three", 3: other}
