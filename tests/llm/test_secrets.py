"""Whole secrets: longer than any limit, and beside base spans."""

import pytest

pytest.importorskip("public_tokenizers")

from cellcnv.llm import pii  # noqa: E402


def test_whole_secrets_go(spark):
    token, long_hex, ones = "eyJ" + "aZ09_-." * 120, "0a9f" * 40, "1" * 50_000
    texts = [
        f"my api_key={token} end", f"see {long_hex} end", f"my token={ones} end", "my password=head7.x@site.org!tail#99 end", "my password=me@site.org end",
        *(f"secret: s3cr3t{i}x{i}yz end" for i in range(40)), *(f"{i:032x} end" for i in range(1, 40)),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert out[0] == "my <SECRET> end" and out[1] == "see <SECRET> end" and out[2] == "my <SECRET> end"
    assert out[3] == "my <SECRET><EMAIL><SECRET> end" or "tail" not in out[3] and "<EMAIL>" in out[3]
    assert out[4] == "my password=<EMAIL> end" or out[4] == "my <EMAIL> end"
    found = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    assert found[0] == f"secret:3:{3 + 8 + len(token)}" and found[1] == f"secret:4:{4 + len(long_hex)}"
