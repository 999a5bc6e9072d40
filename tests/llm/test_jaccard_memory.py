"""What a worker of the n-gram join holds at once."""

import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import xxhash

from cellcnv.llm import jaccard

CHARS = 12_000_000


def test_a_batch_is_dealt_in_pieces_that_a_worker_has_room_for(monkeypatch):
    monkeypatch.setattr(jaccard, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    words = " ".join(f"{k * 7919 % 99991:05d}" for k in range(20_000))
    rows = [words[start : start + 4000] for start in range(0, 96_000, 32)]
    texts = [None, *(f"{k} {t}" for k, t in enumerate(rows)), "x " * 20]
    assert sum(map(len, rows)) == CHARS
    batch = pa.record_batch({"doc_": pa.array(range(len(texts)), pa.int64()), "at_": pa.array(range(len(texts)), pa.int64()), "text_": pa.array(texts, pa.string())})
    seen, found = 0, []
    tracemalloc.start()
    for out in jaccard._dealt(64, 5)([batch]):
        head = out.column("head")[-1].as_py()
        grams = b"".join(x or b"" for x in out.column("grams").to_pylist())
        assert len(grams) == 6 * sum(head["n"])
        seen = max(seen, sum(head["n"]))
        found += [(doc, head["digests"][k]) for doc, k in zip(head["docs"], head["own"])]
        del out, head, grams
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Whole: every row once, with its own set.
    assert found == [(k, xxhash.xxh3_128_digest(jaccard.shingle_hashes(t or "").tobytes())) for k, t in enumerate(texts)]
    assert peak < 5 * CHARS + 20_000_000, (peak, seen)
