"""Ids of the packing operator against the tokenizers library, and groups of null and repeated ids."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

P = pytest.importorskip("public_tokenizers")

from cellcnv.llm import packing  # noqa: E402

HARD = [
    "", "don't 'tis ''s it's'll they've're x'DAY 'S", "a1b22c3.4,5", "Größe, ÉCOLE… naïve's 'é", "ẖH̱ ẖ Á İstanbul ΣΑΣ ς", "\x00a\x0bB\x0cC\x1fD\x7f",
    "a b\u0085c d", "<|endoftext|>x<|startoftext|>", "'", "'s", "x'", "tab\tnl\ncr\r end ", "日本語のテキスト。12３４ ١٢", "ß'S ñ't", "é's", "abc'", "s",
]


def fresh():
    """A tokenizer whose switches are as the library sets them."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_ids_equal_the_library():
    ids_of = packing.ids_by(P.path("word_bpe_49k.json"), 2)
    assert isinstance(ids_of, packing.WordIds)
    rng, letters = random.Random(1), "aAbBsStTrReEvVmMlLdD'’\".,-19 \n\téÉßİ̱́日🙂\x00\x0b"
    drawn = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(5000)]
    documents = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    for texts in (HARD, [""], drawn, documents, ["word " * 200_000 + "é"]):
        ids, ends = ids_of.stream(pa.array(texts, pa.string()))
        begins = [0, *ends.tolist()[:-1]]
        for a, b, found in zip(begins, ends.tolist(), fresh().encode_batch(texts, add_special_tokens=False)):
            assert ids[a:b].tolist() == [*found.ids, 2]
        plain, same = packing.PlainIds(ids_of.tokenizer, 2).stream(pa.array(texts[:50], pa.string()))
        assert same.tolist() == ends[:50].tolist() and (plain == ids[: same[-1]]).all()


def test_strings_of_added_tokens_become_those_tokens():
    ids_of, plain = packing.ids_by(P.path("word_bpe_49k.json"), 2), fresh()
    rng, parts = random.Random(3), ["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|end", "oftext|>", " ", "hello", "wor", "é", "'s", "\n"]
    texts = [*parts, "hello <|endoftext|> world", "in<|endoftext|>side", "<|startoftext|><|endoftext|>", "no such string", ""]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(400)]
    assert len(plain.encode("hello <|endoftext|> world", add_special_tokens=False).ids) == 3
    for some in (texts, texts[5:90], ["<|endoftext|>"]):
        ids, ends = ids_of.stream(pa.array(some, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip([0, *ends.tolist()[:-1]], ends.tolist())] == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in some]


def test_slices_and_forgetting(monkeypatch):
    monkeypatch.setattr(packing, "WORD_CACHE", 20)
    ids_of = packing.ids_by(P.path("word_bpe_49k.json"), 2)
    for _ in range(2):
        ids, ends = ids_of.stream(pa.array(HARD, pa.string()).slice(3, 6))
        assert ids.tolist() == [i for t in HARD[3:9] for i in [*fresh().encode(t, add_special_tokens=False).ids, 2]] and ends[-1] == len(ids)


def test_null_and_repeated_ids_are_dealt_to_many_groups(spark):
    rows = [(None, "some words here"), (7, "the same again")] * 200 + [(8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = packing.pack_documents(docs, P.path("word_bpe_49k.json"), docs_per_group=20).toPandas()
    assert len(found) == 401 and found.doc_id.isna().sum() == 200 and found[found.doc_id == 8].length.tolist() == [1]
    assert (found[found.doc_id.isna()].sequence_id // (1 << 32)).nunique() > 10
    for _, s in found.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["length"].sum() <= 4096 and (s["offset"].to_numpy() == np.cumsum([0, *s["length"]])[:-1]).all()
