"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that the canonical encoding of that prefix ends
with. `PrefixEncoding` stores it for each prefix, so the encoding is read backwards from the end, bytes can
be appended with work only for the new prefixes, and an edit re-encodes only the prefixes from the edit on.
A candidate last token is valid if it stays apart from the last token of the prefix before it, that is, if
the merges would not join across their border.

Defined results: null and empty texts give no tokens; any text round-trips; an empty table gives an empty
result; columns other than doc_id and text are ignored; repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table, texts

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Pieces whose encoding a worker remembers at most.
PIECE_CACHE = 1_500_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Vocabulary:
    """Tokens by rank, with the pair of tokens that each one was merged from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        by_last: dict[int, set[int]] = {}
        for token in ranks:
            by_last.setdefault(token[-1], set()).add(len(token))
        #: By the last byte of a prefix and the prefix's length (up to the longest token): the lengths of tokens
        #: that can end there, longest first.
        self.lengths = {b: [tuple(sorted((n for n in found if n <= end), reverse=True)) for end in range(self.longest + 1)] for b, found in by_last.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.apart_of: dict[tuple[int, int], bool] = {}

    def split_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for single bytes."""
        if token not in self.parts:
            text = self.tokens[token]
            merged = self.merge(text, below=token) if len(text) > 1 else []
            self.parts[token] = (merged[0], merged[1]) if len(merged) == 2 else None
        return self.parts[token]

    def merge(self, text: bytes, below: int | None = None) -> list[int]:
        """Plain merging by lowest rank, with ranks under `below` only."""
        ranks, parts = self.ranks, [text[i : i + 1] for i in range(len(text))]
        limit = len(ranks) + 1 if below is None else below
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
            if rank >= limit:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def apart(self, left: int, right: int) -> bool:
        """Whether merging left's and right's bytes gives back these two tokens."""
        key = (left, right)
        found = self.apart_of.get(key)
        if found is None:
            if len(self.apart_of) > 2_000_000:
                self.apart_of.clear()
            found = self.apart_of[key] = self._apart(left, right)
        return found

    def _apart(self, left: int, right: int) -> bool:
        """Walk both merge trees along the border, undoing the later merge first.

        At any time the two tokens that touch must not have a merge that would have come before the merge
        being undone.
        """
        ranks, tokens, limit = self.ranks, self.tokens, len(self.ranks) + 1
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < limit:
                return False
            a, b = self.split_of(left), self.split_of(right)
            if a is None and b is None:
                return True
            # The token with the higher rank was merged later. Among equal ranks the leftmost merge comes first,
            # so undoing the right token also gives way to a merge of its own rank.
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]


class PrefixEncoding:
    """The last token of every prefix of some bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> PrefixEncoding:
        """Extend the bytes; what was stored for earlier prefixes stays."""
        begin = len(self.data)
        data = self.data = self.data + more
        v, last = self.vocabulary, self.last
        get, lengths, apart_of, longest = v.ranks.get, v.lengths, v.apart_of, v.longest
        for end in range(begin + 1, len(data) + 1):
            for n in lengths[data[end - 1]][end if end < longest else longest]:
                token = get(data[end - n : end])
                if token is None:
                    continue
                if n == end:
                    fits = end == 1 or v.split_of(token) is not None
                else:
                    fits = apart_of.get((last[end - n], token))
                    if fits is None:
                        fits = v.apart(last[end - n], token)
                if fits:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary has no token for a single byte")
        return self

    def replace(self, start: int, end: int, new: bytes) -> PrefixEncoding:
        """Replace data[start:end]; prefixes up to start keep their tokens, later ones are encoded again."""
        tail = new + self.data[end:]
        self.data, self.last = self.data[:start], self.last[: start + 1]
        return self.append(tail)

    def ids(self) -> list[int]:
        out, end, tokens = [], len(self.data), self.vocabulary.tokens
        while end:
            out.append(self.last[end])
            end -= len(tokens[self.last[end]])
        return out[::-1]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(load_ranks(path))


def encode_piece(v: Vocabulary, piece: bytes) -> list[int]:
    whole = v.ranks.get(piece)
    return [whole] if whole is not None else PrefixEncoding(v, piece).ids()


def encode_sorted(v: Vocabulary, pieces: list[bytes]):
    """Encodings of sorted pieces; each one keeps what the one before it has stored for their common prefix."""
    running = PrefixEncoding(v)
    for piece in pieces:
        whole = v.ranks.get(piece)
        if whole is not None:
            yield [whole]
            continue
        before, same = running.data, 0
        for a, b in zip(before, piece):
            if a != b:
                break
            same += 1
        yield running.replace(same, len(before), piece[same:]).ids()


def encoder(path: str, pattern: str):
    """A mapInArrow function: whole texts to token counts and digests of ids and decoded bytes."""

    def run(batches):
        import regex

        v, find = vocabulary(path), regex.compile(pattern).findall
        known: dict[str, tuple[str, bytes, int]] = {}
        tokens = v.tokens
        for batch in batches:
            out = []
            found = [find(t) for t in batch.column("text").to_pylist()]
            new = set().union(*found).difference(known)
            if len(known) + len(new) > PIECE_CACHE:
                known.clear()
                new = set().union(*found)
            new = sorted((p.encode(), p) for p in new)
            for (_, piece), ids in zip(new, encode_sorted(v, [p for p, _ in new])):
                known[piece] = (" ".join(map(str, ids)), b"".join([tokens[i] for i in ids]), len(ids))
            for doc_id, pieces in zip(batch.column("doc_id").to_pylist(), found):
                got = [known[p] for p in pieces]
                out.append((
                    doc_id,
                    sum([g[2] for g in got]),
                    hashlib.sha256(" ".join([g[0] for g in got]).encode()).hexdigest(),
                    hashlib.sha256(b"".join([g[1] for g in got])).hexdigest(),
                ))
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token ids of each document as an array."""

    def run(batches):
        import regex

        v, find = vocabulary(path), regex.compile(pattern).findall
        for batch in batches:
            ids = [[i for p in find(t) for i in encode_piece(v, p.encode())] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """Bytes of each row's ids; ids that the vocabulary lacks raise KeyError. Null ids give empty bytes."""

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            data = [b"".join([v.tokens[i] for i in ids or ()]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return texts(docs).mapInArrow(encoder(path, pattern), ENCODED)


def op8_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
