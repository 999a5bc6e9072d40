"""Packing token streams into fixed-length sequences: first-fit decreasing over a tournament tree.

Each document is tokenised and followed by the end id; streams longer than the sequence length are cut at
its multiples, so only one piece of a document is shorter. The pieces are dealt into randomised groups of
bounded expected size; each group is packed on its own by first-fit decreasing, with a tournament tree over
the bins' free room, so a piece finds the leftmost bin that takes it in logarithmic time.

Defined results: null or empty text gives one piece with the end id only; repeated rows are packed like any
others; equal lengths are placed in order of (doc_id, start); an empty table gives an empty result; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
import json
import re
import string
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, texts

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, dealt long"
PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "dealt"]
#: Tokens whose ids a task remembers at most, and bytes of text that are cut into tokens at once.
WORD_CACHE = 1_000_000
CHUNK_BYTES = 1 << 21
#: ASCII punctuation that words end with.
PUNCTUATION = string.punctuation
BLANK, LETTER, DIGIT, OTHER, ODD = range(5)

# The rules of the tokenizer file that WordIds follows.
CONTRACTIONS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
MODEL_RULES = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "ignore_merges": False}


def byte_kinds() -> np.ndarray:
    """Blank, letter, digit, other printable character, or odd (control and non-ASCII), for each byte."""
    out = np.full(256, ODD, np.uint8)
    out[33:127] = OTHER
    for kind, members in ((LETTER, string.ascii_letters), (DIGIT, string.digits), (BLANK, " \t\n\r")):
        out[list(members.encode())] = kind
    return out


KINDS = byte_kinds()


class TournamentTree:
    """Free room of bins at the leaves, each inner node the larger of its two children."""

    def __init__(self, n_bins: int, room: int):
        self.size = 1 << max(0, (max(1, n_bins) - 1).bit_length())
        self.best = [room] * (2 * self.size)

    def place(self, length: int) -> tuple[int, int]:
        """Put a piece into the leftmost bin with room; returns the bin and the room it had."""
        best, node = self.best, 1
        if best[1] < length:
            raise ValueError("no bin has room")
        while node < self.size:
            node *= 2
            if best[node] < length:
                node += 1
        room, at = best[node], node - self.size
        best[node] = room - length
        node //= 2
        while node:
            top = max(best[2 * node], best[2 * node + 1])
            if best[node] == top:
                break
            best[node] = top
            node //= 2
        return at, room


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Pieces are placed from the longest down, ties in the given order."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    full = lengths >= capacity
    n_full = int(full.sum())
    bins[full] = np.arange(n_full)
    rest = np.flatnonzero(~full)
    order = rest[np.argsort(-lengths[rest], kind="stable")]
    if len(order):
        tree = TournamentTree(len(order), capacity)
        for i, length in zip(order.tolist(), lengths[order].tolist()):
            at, room = tree.place(length)
            bins[i], offsets[i] = n_full + at, capacity - room
    return bins, offsets


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies use for each byte: itself where it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def token_starts(data: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of joined texts: the kind of each byte, where tokens start, what belongs to tokens (all but blanks), and to whole words.

    A blank-separated word of printable ASCII is cut as the word pattern cuts it: runs of letters, single digits,
    runs of others, and the contractions, which begin at an apostrophe that stands alone. Other words are one token.
    """
    kind = KINDS[data]
    kept = kind != BLANK
    word = kept.copy()  # where a word starts
    word[1:] &= ~kept[:-1]
    word[text_starts] = kept[text_starts]
    first = np.flatnonzero(word)
    start = word | (kind == DIGIT)
    start[1:] |= (kind[1:] != kind[:-1]) & kept[1:]
    quote = np.flatnonzero((data == ord("'")) & start)
    for ending in CONTRACTIONS:
        at = quote[quote < len(data) - len(ending)]
        same = np.ones(len(at), bool)
        for k, letter in enumerate(ending, 1):
            # A new word begins where a text begins, so an ending can't reach into the next text.
            same &= ((data[at + k] | 0x20) == letter) & (kind[at + k] == LETTER) & ~word[at + k]
        at, quote = at[same], quote[~np.isin(quote, at[same])]
        start[at + 1] = False
        after = at + 1 + len(ending)
        after = after[after < len(data)]
        start[after[kept[after]]] = True
    whole = np.zeros(len(data), bool)
    if len(first):
        whole[first[0] :] = np.repeat(np.maximum.reduceat(kind, first) == ODD, np.diff(np.append(first, len(data))))
    start &= ~whole
    start[first] = True
    return kind, start, kept, whole


class WordIds:
    """Ids of tokens, learnt once each: all ids in one array, with where each token's begin and how many they are."""

    def __init__(self, tokenizer, end_id: int, added: list[str]):
        self.tokenizer, self.end_id = tokenizer, end_id
        #: Texts that hold an added token, in capitals or not, go through the whole tokenizer.
        self.added = "|".join(map(re.escape, added))
        self.letters = dict(enumerate(byte_letters()))
        self.forget()

    def forget(self):
        self.known = {"": 0}  # number 0 ends a document
        self.flat, self.begin, self.size = np.array([self.end_id], "<u4"), np.zeros(1, np.int64), np.ones(1, np.int64)

    def numbers(self, tokens: list[str]) -> np.ndarray:
        """The number of each token; ASCII tokens come in lower case."""
        missing = [t for t in tokens if t not in self.known]
        if missing:
            if len(self.known) + len(missing) > WORD_CACHE:
                self.forget()
                missing = tokens
            found = self.learnt(missing)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(found), "<u4", int(sizes.sum()))])
            self.known.update(zip(missing, range(len(self.known), len(self.known) + len(missing))))
        return np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))

    def learnt(self, tokens: list[str]) -> list[list[int]]:
        """Ids of each token. A token that is one match of the pattern needs only the merges; others take the whole tokenizer."""
        tokenize, letters, out, others = self.tokenizer.model.tokenize, self.letters, [], []
        for i, token in enumerate(tokens):
            if token.isascii():
                if token.isprintable():
                    out.append([t.id for t in tokenize(token)])
                    continue
            else:
                core = token.rstrip(PUNCTUATION)
                if core.isalpha() and unicodedata.is_normalized("NFC", core):
                    low = core if core.islower() else "".join(map(str.lower, core))
                    if low.isalpha():
                        ids = [t.id for t in tokenize(low.encode().decode("latin-1").translate(letters))]
                        tail = token[len(core) :]
                        out.append(ids + [t.id for t in tokenize(tail)] if tail else ids)
                        continue
            out.append([])
            others.append(i)
        for at in range(0, len(others), 20_000):
            some = others[at : at + 20_000]
            for i, found in zip(some, self.tokenizer.encode_batch_fast([tokens[i] for i in some], add_special_tokens=False)):
                out[i] = found.ids
        return out

    def stream(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end id, and where each text's ids end."""
        odd = pc.match_substring_regex(texts, self.added, ignore_case=True) if self.added else None
        if odd is None or not pc.any(odd).as_py():
            return self._stream(texts)
        ids, ends = self._stream(pc.if_else(odd, "", texts))
        places = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        found, found_ends = PlainIds(self.tokenizer, self.end_id).stream(texts.filter(odd))
        parts, done, more = [], 0, np.zeros(len(texts), np.int64)
        for k, own in zip(places, np.split(found, found_ends[:-1])):
            parts += [ids[done : ends[k] - 1], own]
            done, more[k] = ends[k], len(own) - 1
        return np.concatenate([*parts, ids[done:]]), ends + np.cumsum(more)

    def _stream(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        offset = texts.offset
        bounds = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * offset).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        begins = ends - (bounds[1:] - bounds[:-1])
        kind, start, kept, whole = token_starts(data, begins[begins < ends])
        place = np.cumsum(kept, dtype=np.int32)
        first = np.flatnonzero(start)
        offsets = np.append(place[first] - 1, place[-1] if len(place) else 0).astype(np.int32)
        # Whole words keep their case here: their letters may have to be joined with marks first.
        lower = data + ((kind == LETTER) & (data < 97) & ~whole).astype(np.uint8) * np.uint8(32)
        words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(lower[kept])))
        coded = words.dictionary_encode()
        number = self.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(first) else np.zeros(0, np.int64)
        last = np.searchsorted(first, ends, side="left")
        number = np.insert(number, last, 0)
        sizes = self.size[number]
        done = np.cumsum(sizes)
        at = np.repeat(self.begin[number] - done + sizes, sizes)
        at += np.arange(len(at))
        return self.flat[at], done[last + np.arange(len(last))]


class PlainIds:
    """Ids by the tokenizer itself, for tokenizers whose rules WordIds doesn't know."""

    def __init__(self, tokenizer, end_id: int):
        self.tokenizer, self.end_id = tokenizer, end_id

    def stream(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [[*self.tokenizer.encode(t, add_special_tokens=False).ids, self.end_id] for t in texts.to_pylist()]
        return np.fromiter(itertools.chain.from_iterable(found), "<u4"), np.cumsum([len(f) for f in found], dtype=np.int64)


def ids_by(tokenizer_path: str, end_id: int):
    """The id stream of a tokenizer file: WordIds where the file's rules are those it is made for."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    with open(tokenizer_path, encoding="utf-8") as f:
        rules = json.load(f)
    model = {k: rules["model"].get(k) for k in MODEL_RULES}
    known = rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == PRE_TOKENIZER and model == MODEL_RULES and not rules["post_processor"]
    return WordIds(tokenizer, end_id, [t["content"] for t in rules["added_tokens"]]) if known else PlainIds(tokenizer, end_id)


def text_chunks(batch: pa.RecordBatch):
    """Slices of a batch with about CHUNK_BYTES of text each."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(), dtype=np.int64)
    cuts = [0, *np.flatnonzero(np.diff(ends // CHUNK_BYTES, prepend=0)).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def word_token_pieces(tokenizer_path: str, end_id: int, capacity: int):
    """A mapInArrow function: documents to their pieces, with a checksum of each piece's ids and a number for dealing."""

    def run(batches):
        from pyspark import TaskContext

        ids_of, context, dealt = ids_by(tokenizer_path, end_id), TaskContext.get(), 0
        task = context.partitionId() if context else 0
        for batch in batches:
            for part in text_chunks(batch):
                ids, ends = ids_of.stream(part.column("text"))
                view, start_of, out = memoryview(ids.tobytes()), 0, []
                for doc_id, end in zip(part.column("doc_id").to_pylist(), ends.tolist()):
                    n = end - start_of
                    for start in range(0, n, capacity):
                        stop = min(n, start + capacity)
                        out.append((doc_id, start, stop - start, zlib.crc32(view[4 * (start_of + start) : 4 * (start_of + stop)]), n, (task << 40) + dealt))
                        dealt += 1
                    start_of = end
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], PIECE_NAMES)

    return run


def pack(pieces: DataFrame, capacity: int = 4096, n_groups: int = 1, seed: int = 7) -> DataFrame:
    """Pack pieces (doc_id, start, length, dealt and more columns) into sequences; adds sequence_id and offset.

    Groups are random by dealt, a number of each piece's own, so neither null nor repeated ids meet in one group.
    """
    kept = [f for f in pieces.schema if f.name != "dealt"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"

    def packed(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("doc_id", "start", "dealt")]).select([f.name for f in kept])
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        return group.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    grouped = pieces.withColumn("pack_group_", bucket("dealt", n=n_groups, seed=seed))
    return grouped.groupBy("pack_group_").applyInArrow(packed, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, docs_per_group: int = 1000, seed: int = 7) -> DataFrame:
    """Tokenise and pack documents; the number of groups follows the number of rows."""
    n_groups = max(1, -(-docs.count() // docs_per_group))
    pieces = texts(docs).mapInArrow(word_token_pieces(tokenizer_path, end_id, capacity), PIECES)
    return pack(pieces, capacity, n_groups, seed)


def op9_packing(spark, sf_dir):
    import public_tokenizers

    from .common import table

    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
