"""Spelling variants: words one code point apart, found by search schemes on full-text indexes of the vocabulary.

Of a word and another within one error, either the first or the second half is the same in both. The search schemes
follow: match the second half exactly from the end of the words and extend to the left with one error at most, or
match the first half from the start and extend to the right. An index has two transforms for the two directions: the
Burrows-Wheeler transform of the delimited vocabulary, in which a match grows to the left, and that of its mirror
image, in which it grows to the right. A match is an interval of suffix ranks; all searches of a shard go on together,
one code point a step, and a branch at an error takes only code points that its interval holds.

The vocabulary is dealt by halves: a word is searched for in the shards of its own two halves and stands as text in
those of every half that a word one shorter, as long or one longer can share with it, so shards need each other no
more. A half with over HALF_WORDS words is split into cells, each with a part of its texts and a part of its searches.

Defined results: null and empty texts have no words; a null doc_id deletes nothing; repeated rows count each; ties
between forms go to the word that is first in code-point order; an empty table, or one without such words, gives an
empty result; extra columns are ignored; words may be of any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, stored, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: A run whose number is divisible by this loses a code point.
DELETE_EVERY = 97
#: Words of a shard on average, shards at least, words of a half that are not split.
SHARD_WORDS, SHARDS, HALF_WORDS = 20_000, 64, 20_000


def runs_of(doc_id: int | None, text: str) -> Counter:
    """The runs of a text with their numbers, after the deletions."""
    found: Counter = Counter()
    prefix = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():  # bytes: only A-Z change
        if doc_id is not None and (number := zlib.crc32(run.encode(), prefix)) % DELETE_EVERY == 0:
            at = number % len(run)
            run = run[:at] + run[at + 1 :]
        found[run] += n
    return found


def vocabulary(docs: DataFrame, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """word and n of all runs of enough code points and occurrences."""

    def run(batches):
        for batch in batches:
            found: Counter = Counter()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found.update(runs_of(doc_id, text or ""))
            words = [w for w in found if len(w) >= least_length]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([found[w] for w in words], pa.int64())], ["word", "n"])

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


class Transform:
    """The Burrows-Wheeler transform of words, each ended by a delimiter (code 0) that ranks by the word's number."""

    def __init__(self, words: list[np.ndarray], alphabet: int):
        self.n = len(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        self.text = np.zeros(int(ends[-1]) + 1 if len(words) else 0, np.int64)
        inside = np.ones(len(self.text), bool)
        inside[ends] = False
        self.text[inside] = np.concatenate(words)
        self.word = np.cumsum(~inside) - ~inside
        suffixes = self._sorted(ends)
        before = np.where(suffixes > 0, self.text[suffixes - 1], 0)
        #: The code before each suffix, by suffix rank; 0 where a word starts.
        self.before = before
        order = np.argsort(before, kind="stable")
        self.places, self.starting = (before[order] << 32) | order, self.word[suffixes]
        codes = np.arange(alphabet + 1, dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=alphabet + 1))[:-1]])
        self.base = first - np.searchsorted(self.places, codes << 32)

    def _sorted(self, ends: np.ndarray) -> np.ndarray:
        """Starts of the suffixes in their order, by doubling the length that is compared."""
        rank = self.text + self.n
        rank[ends] = np.arange(self.n)
        length, order = 1, np.argsort(rank, kind="stable")
        while True:
            # What reaches beyond its delimiter is told apart already.
            beyond = np.minimum(np.arange(len(rank)) + length, len(rank) - 1)
            key = (rank << 32) | rank[beyond] if length > 1 or len(rank) else rank
            order = np.argsort(key, kind="stable")
            rank_ = np.empty_like(rank)
            rank_[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0])) if len(rank) else 0
            rank, length = rank_, 2 * length
            if not len(rank) or rank[order[-1]] == len(rank) - 1:
                return order

    def extended(self, code: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The border of an interval after its matches are extended by a code."""
        return self.base[code] + np.searchsorted(self.places, (code << 32) | rank)

    def words_at(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the match is a whole word, and that word's number."""
        at, end = np.searchsorted(self.places, low), np.searchsorted(self.places, high)
        whole = (at < end) & (at < self.n)
        return whole, self.starting[self.places[np.where(whole, at, 0)] & 0xFFFFFFFF]

    def branches(self, low: np.ndarray, high: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All extensions of intervals by one code: number of the interval, code, new borders."""
        width = high - low
        wide = np.flatnonzero(width > alphabet)
        narrow = np.flatnonzero(width <= alphabet)
        of = np.repeat(narrow, width[narrow])
        rows = np.arange(len(of)) - np.repeat(np.cumsum(width[narrow]) - width[narrow], width[narrow]) + low[of]
        seen = np.unique(of * (alphabet + 1) + self.before[rows])
        of, code = seen // (alphabet + 1), seen % (alphabet + 1)
        of, code = np.concatenate([of[code > 0], np.repeat(wide, alphabet)]), np.concatenate([code[code > 0], np.tile(np.arange(1, alphabet + 1), len(wide))])
        new_low, new_high = self.extended(code, low[of]), self.extended(code, high[of])
        some = new_low < new_high
        return of[some], code[some], new_low[some], new_high[some]


def one_error(texts: list[str], searches: list[str], exact: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (search, text) of the pairs one error apart whose last exact[k] code points are the same."""
    if not texts or not searches:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in [*texts, *searches]]
    codes = np.unique(np.concatenate(points))
    points = [np.searchsorted(codes, p).astype(np.int64) + 1 for p in points]
    alphabet, index = len(codes), Transform(points[: len(texts)], len(codes))
    ask = [p[::-1] for p in points[len(texts) :]]
    length, exact_ = np.array([len(p) for p in ask]), np.array(exact)
    offset = np.cumsum(length) - length
    ask = np.concatenate([*ask, [0]])
    who, low, high = np.arange(len(searches)), np.zeros(len(searches), np.int64), np.full(len(searches), len(texts))
    erred = [(who[:0], low[:0], high[:0])]
    found = []
    for step in range(int(length.max()) + 1):
        now, later = erred, []
        at_error = step >= exact_[who]
        w, a, b = who[at_error], low[at_error], high[at_error]
        of, code, new_a, new_b = index.branches(a, b, alphabet)
        now.append((w[of], new_a, new_b))  # the text has one more
        left = step < length[w[of]]
        other = left & (code != ask[np.where(left, offset[w[of]] + step, 0)])
        later.append((w[of][other], new_a[other], new_b[other]))  # another in its place
        left = step < length[w]
        later.append((w[left], a[left], b[left]))  # the text has one less
        w, a, b = (np.concatenate(x) for x in zip(*now))
        ended = step == length[w]
        whole, word = index.words_at(a[ended], b[ended])
        found.append((w[ended][whole], word[whole]))
        for rest, states in ((~ended, (w, a, b)), (step < length[who], (who, low, high))):
            w, a, b = (x[rest] for x in states)
            code = ask[offset[w] + step]
            a, b = index.extended(code, a), index.extended(code, b)
            some = a < b
            if states[0] is who:
                who, low, high = w[some], a[some], b[some]
            else:
                later.append((w[some], a[some], b[some]))
        erred = later
        if not len(who) and not any(len(x[0]) for x in erred):
            break
    pairs = np.unique(np.stack([np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])]), axis=1)
    return pairs[0], pairs[1]


def _near(group: pa.Table) -> pa.Table:
    """word, near and the number of near of all pairs of a shard."""
    out: list[tuple[str, str, int]] = []
    rows = group.to_pydict()
    for first_half in (False, True):
        mine = [k for k, side in enumerate(rows["first_half"]) if side == first_half]
        texts = {rows["word"][k]: rows["n"][k] for k in mine if rows["as_text"][k]}
        searches = sorted({rows["word"][k] for k in mine if rows["as_search"][k]})
        words = list(texts)
        turn = (lambda w: w[::-1]) if first_half else (lambda w: w)
        exact = [len(w) // 2 if first_half else len(w) - len(w) // 2 for w in searches]
        for q, t in zip(*one_error([turn(w) for w in words], [turn(w) for w in searches], exact)):
            out.append((searches[q], words[t], texts[words[t]]))
    word, near, n = zip(*out) if out else ((), (), ())
    return pa.table({"word": pa.array(word, pa.string()), "near": pa.array(near, pa.string()), "near_n": pa.array(n, pa.int64())})


def near_words(words: DataFrame, least_length: int = 5, shard_words: int = SHARD_WORDS, half_words: int = HALF_WORDS) -> DataFrame:
    """word, near and near_n of all pairs of words (word, n) that are one code point apart, each in both directions."""
    k = F.char_length("word")
    around = F.filter(F.sequence(k - 1, k + 1), lambda m: m >= least_length)
    first = lambda m: F.substring("word", F.lit(1), F.floor(m / 2).cast("int"))
    last = lambda m: F.col("word").substr(F.floor(m / 2).cast("int") + k - m + 1, k)  # noqa: E731  the last m - m div 2 of the k code points

    def halves(side: bool, half):
        return F.transform(F.array_distinct(F.transform(around, half)), lambda h: F.struct(F.lit(side).alias("first_half"), h.alias("half"), (h == half(k)).alias("searched")))

    dealt = words.select("word", "n", F.explode(F.concat(halves(False, last), halves(True, first))).alias("h")).select("word", "n", "h.*")
    crowded = dealt.groupBy("first_half", "half").agg(F.count("*").alias("size")).where(F.col("size") > half_words)
    crowded = crowded.select("first_half", "half", F.ceil(F.col("size") / half_words).cast("int").alias("parts"))
    dealt = dealt.join(crowded, ["first_half", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    cell = lambda i, j, as_text, as_search: F.struct(i.alias("i"), j.alias("j"), as_text.alias("as_text"), as_search.alias("as_search"))
    as_texts = F.transform(every, lambda j: cell(F.col("own"), j, F.lit(True), (j == F.col("own")) & F.col("searched")))
    searches = F.transform(F.filter(every, lambda i: (i != F.col("own")) & F.col("searched")), lambda i: cell(i, F.col("own"), F.lit(False), F.lit(True)))
    dealt = dealt.withColumn("c", F.explode(F.concat(as_texts, searches)))
    shards = max(SHARDS, -(-4 * words.count() // shard_words))
    shard = F.pmod(F.xxhash64("first_half", "half", "c.i", "c.j"), F.lit(shards)).cast("int").alias("shard")
    dealt = dealt.select(shard, "first_half", "word", "n", "c.as_text", "c.as_search")
    # Cells that share a shard, and words that share both halves' letters, may give a pair twice.
    return dealt.groupBy("shard").applyInArrow(_near, "word string, near string, near_n long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root: forms (word, form) are followed to the last; the chain that is followed doubles in each round."""
    found = forms.select("word", F.col("form").alias("root"))
    while True:
        step = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stored(found.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        found = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return found


def spelling_variants(docs: DataFrame, least_length: int = 5, least_n: int = 3, **sizes: int) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word: see the module's text."""
    spark = docs.sparkSession
    words = stored(vocabulary(docs, least_length, least_n), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    near = stored(near_words(words, least_length, **sizes).groupBy("word").agg(F.count("*").alias("n_near"), best), "near")
    taken = F.col("form_n") >= 2 * F.col("n")
    forms = words.join(near.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")), "word", "left")
    forms = forms.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("form")).alias("form"), F.when(taken, F.col("form_n")).alias("form_n"))
    forms = stored(forms, "forms")
    ends = settled(spark, lambda: roots(forms.where("form IS NOT NULL")), "roots")
    return forms.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))
