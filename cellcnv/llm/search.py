"""Exact top-k BM25 search: per-shard inverted indexes with block-max WAND pruning, global statistics.

Documents are dealt in turn to shards of bounded size; document frequencies and the mean length are counted over
all documents, so a shard's scores are final and the shards' lists merge exactly. In a shard, documents that share
their most frequent word stand together, in blocks of neighbours and stretches of some blocks. Where a list holds many
documents of a stretch it stands there as a column of impacts, with its largest impact in each block.

A WAND cursor stops only at a pivot: a document at which the bounds of the lists that can hold it reach the
threshold. Here queries are searched many at a time, and that test runs over a block for all of them. Short lists,
those of the largest weights, are read first; then columns in rising density, in a few parts. Before each part the
documents that are still possible pivots are those whose score so far and the block maxima of the unread columns
reach the query's threshold, which is the k-th best score so far. Queries without one skip the block; the others read
it in one matrix product, or cursors go to the possible pivots alone where they are few. A part of the corpus is
searched first, and its k-th best scores are what all other shards start from. Queries stream from a table in the
shared folder.

A query is the set of distinct words of a whole text. Ranks go by score rounded to 6 digits, then doc_id.
Defined results: queries without words get no rows; documents without words are never found; null texts count
as empty; a null doc_id comes first among ties; repeated rows are found each; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, stored, table, texts
from .warc import filesystem

K1, B = 1.2, 0.75
#: Documents in a block, and blocks in a stretch, for each of which is settled anew which lists are long.
BLOCK, STRETCH = 256, 8
#: A list with one in LONG documents of a stretch or more stands there as a column of impacts; the densest do, COLUMNS a stretch on average at most.
LONG, COLUMNS = 16, 640
#: Densities at which columns are parted: possible pivots are settled anew after each part.
SHARES = np.array([0.2, 0.5])
#: A cursor's way to one document costs as much as SEEK documents of a matrix product, and to load its block as much as FEW queries do.
SEEK, FEW = 32, 16
#: Queries that are searched together, and about how many terms they have at most.
QUERIES, QUERY_TERMS = 512, 400_000
#: One row in so many is searched before the others, for a threshold to begin with.
AHEAD = 8
#: What stands for a null doc_id in a shard.
LOWEST = -(1 << 63)
CHUNK_BYTES = 1 << 22
DF_FLUSH = 2_000_000


def words_of(text: str) -> list[bytes]:
    """What a word is; term_counts cuts whole columns alike."""
    return text.encode().lower().split()


def term_counts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, term (a word's 64-bit hash) and count of each distinct word of each text, by document and term."""
    column = pa.chunked_array([column]) if isinstance(column, pa.Array) else column
    ends = np.cumsum(pc.binary_length(column).to_numpy(), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(ends // CHUNK_BYTES, prepend=0)).tolist()
    parts = []
    for a, b in zip([0, *cuts], [*cuts, len(column)]):
        words = pc.ascii_split_whitespace(pc.ascii_lower(pa.concat_arrays(column.slice(a, b - a).chunks or [pa.array([], column.type)])))
        doc, word = pc.list_parent_indices(words), pc.list_flatten(words)
        real = pc.greater(pc.binary_length(word), 0)
        coded = pc.dictionary_encode(word.filter(real))
        names = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False).view(np.int64)
        by_name = np.argsort(names)
        rank = np.empty(len(names), np.int64)
        rank[by_name] = np.arange(len(names))
        pair, count = np.unique(doc.filter(real).to_numpy().astype(np.int64) * max(1, len(names)) + rank[coded.indices.to_numpy()], return_counts=True)
        number, at = np.divmod(pair, max(1, len(names)))
        parts.append(((number + a).astype(np.int32), names[by_name][at], count.astype(np.int32)))
    number, term, count = (np.concatenate(c) for c in zip(*parts))
    return number, term, count


def statistics(docs: DataFrame) -> DataFrame:
    """term, df: in how many documents each term is; the row with a null term has the number of words in df."""

    def run(batches):
        def rows(held):
            terms, df = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df)], ["term", "df"])

        held, size, total = [], 0, 0
        for batch in batches:
            _, terms, count = term_counts(batch.column("text"))
            held.append(terms)
            size, total = size + len(terms), total + int(count.sum(dtype=np.int64))
            if size > DF_FLUSH:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["term", "df"])

    return docs.mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id and each distinct term of its text."""

    def run(batches):
        for batch in batches:
            number, terms, _ = term_counts(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[number]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms)], ["query_id", "term"])

    return queries.where("doc_id is not null").mapInArrow(run, "query_id long, term long")


def ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start[i], stop[i])."""
    n = stop - start
    end = np.cumsum(n)
    return np.repeat(start - end + n, n) + np.arange(end[-1] if len(end) else 0)


class ShardIndex:
    """Lists by term; where a list is long, columns of impacts with the largest in each block of documents; and the terms of each document."""

    def __init__(self, ids: np.ndarray, documents: pa.Array | pa.ChunkedArray, mean_length: float):
        n = len(ids)
        doc, name, tf = term_counts(documents)
        coded, seen = pd.factorize(name)
        by_name = np.argsort(seen)
        self.names, rank = seen[by_name], np.empty(len(seen), np.int32)
        rank[by_name] = np.arange(len(seen))
        term = rank[coded]
        del name, coded
        sizes = np.bincount(doc, tf, n)
        # Documents with the same most frequent word stand together.
        most = np.zeros(n, np.int32)
        np.maximum.at(most, doc, tf)
        often = np.flatnonzero(tf == most[doc])
        leading = np.full(n, -1, np.int32)
        leading[doc[often]] = term[often]
        order = np.lexsort((sizes, leading))
        place = np.empty(n, np.int32)
        place[order] = np.arange(n)
        self.ids = ids[order]
        impact = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * sizes / mean_length))[doc])
        doc = place[doc]
        by_doc = np.argsort(doc, kind="stable")
        self.own_term, self.own_impact, doc = term[by_doc], impact[by_doc], doc[by_doc]
        del by_doc, impact, tf
        self.own_start = np.searchsorted(doc, np.arange(n + 1))
        by_term = np.argsort(self.own_term, kind="stable")
        doc, term, impact = doc[by_term], self.own_term[by_term], self.own_impact[by_term].astype(np.float32)
        del by_term
        self.n_blocks = -(-n // BLOCK)
        self.size = np.bincount(term, minlength=len(self.names))
        self.weight = np.zeros(len(self.names))
        self.read = self.listed = 0  # postings of the queries' lists that were read, and all of them, unless they aren't counted
        self.counting = True
        # Entries: the runs of one term within one stretch. The densest stand as columns of the stretch, in rising density.
        span = BLOCK * STRETCH
        stretch = doc // span
        entry = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (stretch[1:] != stretch[:-1])])[: len(term)])
        count, where = np.diff(np.append(entry, len(term))), stretch[entry]
        rows = np.diff(np.append(np.arange(0, n, span), n))
        density = count / rows[where]
        long = np.flatnonzero(density * LONG >= 1)
        long = long[np.argsort(-density[long], kind="stable")]
        long = long[np.cumsum(rows[where[long]]) <= COLUMNS * n]
        long = long[np.lexsort((density[long], where[long]))]
        width = np.bincount(where[long], minlength=len(rows))
        first, base = np.cumsum(width) - width, np.cumsum(width * rows) - width * rows
        column = np.full(len(entry), -1, np.int32)
        column[long] = np.arange(len(long)) - first[where[long]]
        column = np.repeat(column, count)
        dense = column >= 0
        cells = np.zeros(int((width * rows).sum()), np.float32)
        at = stretch[dense]
        cells[base[at] + (doc[dense] - at * span) * width[at] + column[dense]] = impact[dense]
        del at, column, stretch
        # A posting of a short list: document and impact side by side, read as one number.
        self.postings = np.stack([doc[~dense], impact[~dense].view(np.int32)], axis=1).view(np.int64).ravel()
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term[~dense], minlength=len(self.names)))])
        of_column = term[entry[long]]
        held = np.unique(of_column)
        self.slot, self.n_slots = np.full(len(self.names), -1, np.int32), len(held)
        self.slot[held] = np.arange(len(held))
        self.stretches = []
        for r, (a, c, x, m) in enumerate(zip(first.tolist(), width.tolist(), base.tolist(), rows.tolist())):
            columns, blocks = cells[x : x + c * m].reshape(m, c), np.arange(0, m, BLOCK)
            cuts = [0, *np.searchsorted(density[long[a : a + c]], SHARES).tolist(), c]
            peak, filled = np.maximum.reduceat(columns, blocks, axis=0), np.add.reduceat((columns > 0).astype(np.float32), blocks, axis=0)
            self.stretches.append((r * span, columns, self.slot[of_column[a : a + c]], list(zip(cuts, cuts[1:])), peak.T, filled.T))

    def whole(self, docs: np.ndarray) -> np.ndarray:
        """Scores of some documents by their own terms, in the order of the terms; minus one for those that share none."""
        out = np.empty(len(docs))
        for i, (start, stop) in enumerate(zip(self.own_start[docs].tolist(), self.own_start[docs + 1].tolist())):
            weight = self.weight[self.own_term[start:stop]]
            out[i] = weight @ self.own_impact[start:stop] if weight.any() else -1.0
        return out

    def search(self, terms: np.ndarray, idf: np.ndarray, k: int, floor: float = -1.0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and rounded scores of the k best documents of one query."""
        return self.search_many([(terms, idf)], np.array([floor]), k)[0]

    def search_many(self, asked: list[tuple[np.ndarray, np.ndarray]], floors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and rounded scores of the k best documents for the terms and weights of each query; those below its floor may be left out.

        Short lists are read first. Then, block by block, a query goes on to the next denser columns while a document of the
        block is a possible pivot: while its score so far and the block maxima of the columns that are left reach the
        threshold, which rises with the k-th best score so far. The queries that go on in a block read its columns in one
        matrix product, or cursors go to the possible pivots alone when they are few.
        """
        n = len(self.ids)
        if not n or not len(self.names) or not asked:
            return [(self.ids[:0], np.zeros(0)) for _ in asked]
        terms, at = np.unique(np.concatenate([terms for terms, _ in asked]), return_inverse=True)
        term = np.searchsorted(self.names, terms)
        term[term == len(self.names)] = 0
        term[self.names[term] != terms] = -1
        term, idf = term[at], np.concatenate([idf for _, idf in asked]).astype(float)
        query = np.repeat(np.arange(len(asked)), [len(terms) for terms, _ in asked])[term >= 0]
        term, idf = term[term >= 0], idf[term >= 0]
        own = np.searchsorted(query, np.arange(len(asked) + 1)).tolist()
        self.listed += int(self.size[term].sum())
        slot = self.slot[term]
        weights = np.zeros((len(asked), self.n_slots), np.float32)
        weights[query[slot >= 0], slot[slot >= 0]] = idf[slot >= 0]
        score = np.zeros((len(asked), n), np.float32)
        start = self.start[term]
        stop = self.start[term + 1]
        for i, (a, b) in enumerate(zip(own, own[1:])):
            read = self.postings[ranges(start[a:b], stop[a:b])].view(np.int32)
            if len(read):
                score[i] = np.bincount(read[::2], read.view(np.float32)[1::2] * np.repeat(idf[a:b], stop[a:b] - start[a:b]), n)
        self.read += int((stop - start).sum())
        # Scores so far are in single precision, so thresholds get a margin; what is returned comes from whole scores.
        bar = lowered(np.asarray(floors, np.float32))
        top = np.full((len(asked), k), -np.inf, np.float32)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for low, columns, slots, stages, peak, filled in self.stretches:
            weight, here = weights[:, slots], score[:, low : low + len(columns)]
            n_blocks = peak.shape[1]
            left = np.zeros((len(stages) + 1, len(asked), n_blocks), np.float32)
            for g, (a, b) in reversed([*enumerate(stages)]):
                left[g] = left[g + 1] + weight[:, a:b] @ peak[a:b]
            if self.counting:
                given = (weight > 0).astype(np.float32)
                postings = np.stack([given[:, a:b] @ filled[a:b] for a, b in stages])
            bound = left[0] + np.maximum.reduceat(here, np.arange(0, len(columns), BLOCK), axis=1)
            for block in range(n_blocks):
                rows = np.flatnonzero(bound[:, block] >= bar)
                if not len(rows):
                    continue
                some = columns[block * BLOCK : (block + 1) * BLOCK]
                s = here[rows, block * BLOCK : (block + 1) * BLOCK]
                q = None
                for g, (a, b) in enumerate([*stages, (0, 0)]):
                    if q is None:
                        alive = s >= (bar[rows] - left[g, rows, block])[:, None]
                        pairs = np.count_nonzero(alive)
                        if pairs * SEEK <= (len(rows) + FEW) * len(some) or g == len(stages):
                            q, d = np.nonzero(alive)
                            s, q = s[q, d], rows[q]
                        else:
                            going = alive.any(axis=1)
                            if not going.all():
                                rows, s = rows[going], s[going]
                            s += weight[rows, a:b] @ some[:, a:b].T
                            if self.counting:
                                self.read += int(postings[g, rows, block].sum())
                    else:
                        on = s >= bar[q] - left[g, q, block]
                        q, d, s = q[on], d[on], s[on]
                    if q is not None and b > a and len(q):
                        s = s + np.einsum("ij,ij->i", weight[q, a:b], some[d, a:b])
                        if self.counting:
                            self.read += int(given[q, a:b].sum())
                if len(q):
                    hits.append((q, d + (low + block * BLOCK), s))
                    rows, at = np.unique(q, return_inverse=True)
                    new = np.full((len(rows), k + len(some)), -np.inf, np.float32)
                    new[:, :k] = top[rows]
                    new[at, k + d] = s
                    top[rows] = np.partition(new, len(some), axis=1)[:, len(some) :]
                    bar[rows] = np.maximum(bar[rows], lowered(top[rows].min(axis=1)))
        q, d, s = (np.concatenate(c) for c in zip(*hits)) if hits else (np.zeros(0, np.int64),) * 3
        keep = s >= bar[q]
        q, d = q[keep], d[keep]
        by_query = np.argsort(q, kind="stable")
        ends, d = np.searchsorted(q[by_query], np.arange(len(asked) + 1)).tolist(), d[by_query]
        out = []
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            if a == b:
                out.append((self.ids[:0], np.zeros(0)))
                continue
            mine = slice(own[i], own[i + 1])
            self.weight[term[mine]] = idf[mine]
            whole = self.whole(d[a:b])
            self.weight[term[mine]] = 0.0
            best, scores = d[a:b][whole >= 0], np.round(whole[whole >= 0], 6)
            order = np.lexsort((self.ids[best], -scores))[:k]
            out.append((self.ids[best[order]], scores[order]))
        return out


def lowered(threshold: np.ndarray) -> np.ndarray:
    """What no document with such a score misses, when scores are summed in single precision and rounded to 6 digits; above zero."""
    return np.maximum(threshold * np.float32(1 - 2e-4) - np.float32(1e-5), np.finfo(np.float32).tiny)


def parts_of(batches, most_bytes: int):
    """Batches (doc_id, text) cut so that none but a single row has more bytes of text."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(), dtype=np.int64)
        cuts = [0, *np.flatnonzero(np.diff(ends // most_bytes, prepend=0)).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _written(queries: DataFrame) -> str:
    """Queries with the same most common word, and then with about as many words, stand together, so that they share lists and blocks."""
    path = fresh_path(queries.sparkSession, "queries")
    queries.orderBy(F.expr("element_at(terms, cast(array_position(idf, array_min(idf)) as int))"), F.size("terms")).write.parquet(path)
    return path


def search(docs: DataFrame, queries: DataFrame, k: int = 10, shard_docs: int = 16_384, shard_words: int = 8_000_000) -> DataFrame:
    """query_id, doc_id, score and rank of the k best documents for each row of queries (both with doc_id and text).

    Rows are dealt in turn, whatever their ids are, to partitions of shard_docs rows and shard_words words at most on
    average; a partition that gets half as much again is searched as several shards, which bounds the memory of a task.
    One row in AHEAD is searched first; the k-th best score there is what every other shard starts from, so the more
    rows there are, the more is pruned. Before those, one in AHEAD of them is, and so on, as long as that fills a shard. Every shard reads all queries: work grows with queries times shards.
    """
    docs, queries = texts(docs), texts(queries)
    counted = stored(statistics(docs), "terms")
    n_docs = docs.count()
    n_words = counted.where("term is null").agg(F.sum("df")).first()[0] or 0
    mean_length = max(1.0, n_words / max(1, n_docs))
    idf = F.log1p((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = query_terms(queries).join(counted.where("term is not null"), "term").select("query_id", "term", idf.alias("idf"))
    lists = weighted.groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("idf").alias("idf"))
    asked = stored(lists.withColumn("floor", F.lit(-1.0)), "queries")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")

    def best(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def hits_in(part: DataFrame, n: int, asked: DataFrame) -> DataFrame:
        n_shards = max(1, -(-n // shard_docs), -(-n_words * n // (shard_words * max(1, n_docs))))
        run = shard_search(_written(asked), k, mean_length, shard_docs * 3 // 2, shard_words * 12)
        return part.withColumn("doc_id", F.coalesce("doc_id", F.lit(LOWEST))).repartition(n_shards).mapInArrow(run, "query_id long, doc_id long, score double")

    def raised(hits: DataFrame) -> DataFrame:
        floors = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
        return asked.join(floors, "query_id", "left").select("query_id", "terms", "idf", F.coalesce("least", "floor").alias("floor"))

    levels = 1
    while n_docs // AHEAD ** (levels + 1) >= shard_docs:
        levels += 1
    found, n_found, done = None, 0, F.lit(False)
    for level in range(levels, -1, -1):
        here = F.pmod(F.xxhash64("doc_id"), F.lit(AHEAD**level)) == 0
        part = docs.where(here & ~done)
        n = part.count() if level else n_docs - n_found
        hits = hits_in(part, n, asked if found is None else raised(found))
        hits = best(hits if found is None else found.unionByName(hits))
        if level:
            found, n_found, done = stored(hits.drop("rank"), "hits"), n_found + n, here
    return hits.select("query_id", F.when(F.col("doc_id") != LOWEST, F.col("doc_id")).alias("doc_id"), "score", "rank")


def shard_search(path: str, k: int, mean_length: float, most_docs: int, most_bytes: int):
    """A mapInArrow function: documents to the hits of all queries stored at path, shard by shard."""

    def answers(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        shard = pa.Table.from_batches(held)
        held.clear()
        index = ShardIndex(shard["doc_id"].to_numpy(), shard["text"], mean_length)
        del shard
        index.counting = False
        where, root = filesystem(path)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in pyarrow.dataset.dataset(root, filesystem=where, format="parquet").to_batches(batch_size=QUERIES, batch_readahead=1, fragment_readahead=1):
            ends = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(), dtype=np.int64)
            cuts = [0, *np.flatnonzero(np.diff(ends // QUERY_TERMS, prepend=0)).tolist(), batch.num_rows]
            for part in (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a):
                asked = [(t.values.to_numpy(), w.values.to_numpy()) for t, w in zip(part.column("terms"), part.column("idf"))]
                floors = part.column("floor").to_numpy()
                for query, (ids, scores) in zip(part.column("query_id").to_pylist(), index.search_many(asked, floors, k)):
                    out.append((np.full(len(ids), query, np.int64), ids, scores))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "doc_id", "score"])

    def run(batches):
        held, rows, size = [], 0, 0
        for part in parts_of(batches, most_bytes // 8):
            n = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held and (rows + part.num_rows > most_docs or size + n > most_bytes):
                yield answers(held)
                held, rows, size = [], 0, 0
            held.append(part)
            rows, size = rows + part.num_rows, size + n
        if held:
            yield answers(held)

    return run


def op3_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.where("doc_id % 50 = 0"))
