"""The training-data operators on small tables with every edge case, against brute force."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from cellcnv.llm import bpe, classifier, packing, pii, rules, search, simhash, suffixes, templates, warc  # noqa: E402

BASE = "The quick brown fox jumps over the lazy dog while seven wise wizards brew tea, and then some more words follow here. "
TEXTS = [
    "", None, "   \n\t ", "one", "two words", BASE * 3, BASE * 3, BASE * 3 + "tail", "x" * 3000, "a b a b a b a b a b",
    "line one is here\nline one is here\nPage 12 of the long report\n" + BASE, "Page 13 of the long report\n" + BASE + "\nmail me@x.org or +1 (212) 555-0199",
    "4111 1111 1111 1111 and 10.0.0.1 and password=hunter22 é😀 and SSN 123-45-6789", "Größe É ñandú don't I'll 12345 <|endoftext|> …", "# $ % | < >\n" * 40, "\x00null\x00byte",
    " ".join(f"w{i}" for i in range(9000)),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, doc_ int"


def table_of(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "z", 1) for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture
def docs(spark):
    return table_of(spark, TEXTS).persist()


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_the_library(spark, docs, empty):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for r in bpe.encode_documents(docs, path, P.PATTERN).collect():
        text = TEXTS[r["doc_id"]] or ""
        ids = reference.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    round_trip = bpe.decode_ids(bpe.encode_ids(docs, path, P.PATTERN), path)
    assert all(bytes(r["data"]) == (TEXTS[r["doc_id"]] or "").encode() for r in round_trip.collect())
    assert bpe.encode_documents(empty, path, P.PATTERN).count() == 0


def test_bpe_prefixes_append_and_edit():
    v = bpe.Vocabulary(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")))
    rng, letters = np.random.default_rng(0), b"etaoin shrdlu"
    for _ in range(60):
        data = bytes(rng.choice(list(letters), 40).astype(np.uint8))
        cut = int(rng.integers(0, 40))
        assert bpe.PrefixEncoding(v, data).ids() == v.merge(data) == bpe.PrefixEncoding(v, data[:cut]).append(data[cut:]).ids()
        new = bytes(rng.choice(list(letters), 5).astype(np.uint8))
        assert bpe.PrefixEncoding(v, data).replace(cut, min(40, cut + 3), new).ids() == v.merge(data[:cut] + new + data[cut + 3 :])


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    found = packing.pack_documents(docs, path, docs_per_group=6).toPandas()
    for doc_id, pieces in found.groupby("doc_id"):
        ids = np.array([*tokenizer.encode(TEXTS[doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = pieces.sort_values("start")
        assert pieces["length"].sum() == len(ids) == pieces["doc_tokens"].iloc[0]
        assert (pieces["start"].to_numpy() == np.cumsum([0, *pieces["length"]])[:-1]).all()
        for r in pieces.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert set(found["doc_id"]) == set(range(len(TEXTS)))
    for _, s in found.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["length"].sum() <= 4096 and (s["offset"].to_numpy() == np.cumsum([0, *s["length"]])[:-1]).all()
    assert packing.pack_documents(empty, path).count() == 0


def test_first_fit_decreasing_equals_a_plain_search():
    lengths = np.random.default_rng(1).integers(1, 4097, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 4096)
    room, expected = [], {}
    for i in sorted(range(300), key=lambda i: (-lengths[i], i)):
        at = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        room[at : at + 1] = [(room[at] if at < len(room) else 4096) - lengths[i]]
        expected[i] = at
    by_bin = lambda of: sorted(sorted(int(lengths[i]) for i in range(300) if of(i) == b) for b in range(300))
    assert by_bin(lambda i: bins[i]) == by_bin(expected.get)


def brute_rules(text):
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), text.split("\n")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    with_word = [x for x in lines if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in with_word[:i] for i, x in enumerate(with_word)), len(covered)


def test_rules(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1) for i in range(len(TEXTS))], "doc_id long, quality int")
    found = rules.quality_rules(docs, labels).collect()
    for r in found:
        base = brute_rules(TEXTS[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and not (r["kept"] and r["base_failed"])
    kept = {r["doc_id"] for r in rules.keep_good(docs, labels).collect()}
    assert kept == {r["doc_id"] for r in found if r["kept"]} and rules.keep_good(docs, labels).columns == docs.columns
    assert rules.quality_rules(empty, labels).count() == 0 and rules.quality_rules(docs, labels.limit(0)).count() == len(TEXTS)


def test_rules_on_labelled_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = rules.op5_quality_rules(spark, sf).where("not base_failed").join(labels, "doc_id").toPandas()
    assert found[found.quality == 1].kept.mean() > 0.97 and found[found.quality == 0].kept.mean() < 0.2


def test_classifier(spark, empty):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = classifier.op1_quality_classifier(spark, sf).join(labels, "doc_id", "left").toPandas()
    assert len(found) == 1000 and found.score.between(0, 1).all() and ((found.score >= 0.5) == found.predicted).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id]).all()
    held = found[found.held_out & found.quality.notna()]
    assert (held.predicted == held.quality).mean() > 0.95
    model = classifier.train(empty, labels)
    assert classifier.score(empty, model).count() == 0 and classifier.score(table_of(spark, TEXTS), model).toPandas().score.eq(0.5).all()


def test_classifier_identity():
    model = classifier.FactorisationMachine(rank=3)
    model.v = np.random.default_rng(2).normal(size=model.v.shape).astype(np.float32)
    at, value, starts = classifier.gathered([("alpha beta gamma alpha", None), ("", 3)])
    for d in range(2):
        a, x = at[starts[d] : starts[d + 1]], value[starts[d] : starts[d + 1]]
        pairs = sum(float(model.v[a[i]] @ model.v[a[j]]) * x[i] * x[j] for i in range(len(a)) for j in range(i))
        assert model.margin(at, value, starts)[d] == pytest.approx(pairs, rel=1e-3, abs=1e-3)


def test_simhash(spark, docs, empty):
    import xxhash

    def brute(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: brute(t or "") for i, t in enumerate(TEXTS)}
    component = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            for j in prints:
                if bin(prints[i] ^ prints[j]).count("1") <= 2:
                    component[i] = component[j] = min(component[i], component[j])
    found = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {i: (f"{prints[i]:016x}", component[i]) for i in prints}
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == set(component.values())
    assert simhash.near_duplicates(empty).count() == 0
    again = simhash.near_duplicates(docs.where("doc_id > 4").unionByName(docs.where("doc_id = 5"))).where("doc_id = 5").collect()
    assert len(again) == 2 and {r["component_id"] for r in again} == {5}


def test_tree_finds_every_close_pair():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    points = np.unique(np.concatenate([points, points[:300] ^ np.uint64(5), points[:200] ^ np.uint64(1 << 40)]))
    tree = simhash.VantageTree(points[rng.permutation(len(points))[:400]], 5)
    at, shard, home = tree.route(points, 2)
    assert tree.leaves > 8 and np.bincount(at[home], minlength=len(points)).max() == 1
    met = {}
    for s in np.unique(shard):
        for a, b in simhash.links_within(points[at[shard == s]], home[shard == s], 2):
            met.setdefault(int(a), set()).add(int(b))
            met.setdefault(int(b), set()).add(int(a))

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            for y in met.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    for p in points[:200]:
        for q in points[np.bitwise_count(points ^ p) <= 2]:
            assert int(q) in reach(int(p))


def brute_repeats(texts, length):
    seen, out = set(), []
    for t in texts:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(data[p : p + length])
        out.append((len(data), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup(spark, docs, empty, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_SNIPPETS", hot)
    found = suffixes.without_repeats(docs).withColumn("sha", F.sha2("kept", 256)).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]) for r in found] == brute_repeats(TEXTS, 100)
    assert suffixes.without_repeats(empty).count() == 0


def test_line_templates(spark, docs, empty, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = templates.op10_line_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()
    db = duckdb.connect()
    db.execute(f"create view documents as select doc_id, text from '{tmp_path}/documents.parquet/*.parquet'")
    assert [tuple(r) for r in found] == sorted(db.sql(templates.OP10_SQL).fetchall())
    assert {r["doc_id"]: r["n_dropped"] for r in found}[11] >= 2  # "Page 13 ..." is the template of "Page 12 ..."
    out = templates.without_recurring_lines(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    assert templates.without_recurring_lines(empty).count() == 0


def luhn(number):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(number))) % 10 == 0


def test_pii(spark, docs, empty):
    def base(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
        number = lambda m: re.sub(r"\D", "", m[0])
        out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(number(m)) <= 19 and luhn(number(m))]
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(number(m)) <= 15]

    more = ["a@b.c_d@e.f x@y@z.com", "1.2.3.4.5.6.7.8 256.1.1.1", "1 2 3 " * 500, "+1-2 ++49 30 1234567"]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(more, 100)), "doc_id long, text string"))
    texts = dict(enumerate(TEXTS)) | dict(enumerate(more, 100))
    for r in pii.find(every).collect():
        spans = base(texts[r["doc_id"]] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert "<EMAIL>" in masked[11] and "<PHONE>" in masked[11] and "4111" not in masked[12] and masked[5] == TEXTS[5] and masked[1] is None
    assert pii.redact(docs).columns == docs.columns and pii.find(empty).count() == 0


def test_warc_round_trip_and_pushdown(spark):
    html = ["<p>a</p>", "", None, "<p>a</p>", "<p>é</p>" * 5000, "<p>a</p>"]
    pages = spark.createDataFrame([(i, f"http://x/{i} y\r\nEvil: 1", h, "z") for i, h in enumerate(html)], "page_id long, url string, html string, digest string")
    for level in (4, 0):
        path = warc.fresh_path(spark, "warc-test")
        warc.write_pages(pages, path, level=level)
        found = {int(r["record_id"]): r for r in warc.read_warc(spark, path, verify="true").collect()}
        assert len(found) == 6
        for i, r in found.items():
            data = (html[i] or "").encode()
            top = max(j for j, h in enumerate(html) if (h or "") == (html[i] or ""))
            assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
            assert (r["record_type"], r["refers_to"]) == (("response", None) if i == top else ("revisit", str(top)))
            assert r["payload"] is None if i != top else bytes(r["payload"]) == data
        pushed = warc.read_warc(spark, path).where("record_type = 'revisit' and payload_bytes > 3")
        assert "Filter (" not in pushed._jdf.queryExecution().executedPlan().toString() and pushed.count() == 2
        assert warc.read_warc(spark, path, payload="false").where("payload is not null").count() == 0
    path = warc.fresh_path(spark, "warc-test")
    warc.write_pages(pages.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0
