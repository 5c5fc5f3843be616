"""Posting lists of documents in segments: packed by Arrow workers where the documents lie, and searched where they are stored.

A segment is a few thousand documents of one task; it is made without a shuffle. Its rows: one for each token with the
places of the documents that have it (ascending), how often, and for each block of BLOCK documents where the list enters it, the corners: those
(count, length) there that no other has as often in as short a document, from which the block's largest weight follows for any parameters. A list of at
most BLOCK documents has no corners, as its own numbers are as few, and nor have lists that aren't scored. The row of
the empty token has the segment's ids and lengths. A task writes runs of segments of about RUN bytes, each sorted by token, into one row group, so
a query's tokens are a few pages of each run, a task's memory doesn't grow with its rows, and one task sees all of a segment: scores need no shuffle by document.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents and tokens of a segment, about.
DOCUMENTS, TOKENS = 1 << 12, 1 << 21
BLOCK = 1 << 6
#: Documents with a query's rarest words that give a first bound, and pairs of queries and documents that are looked at at once.
SEEDS, DENSE = 256, 1 << 16
#: Documents of a segment of about one length, for which bounds are taken, and cells of their table of frequent words.
PART, TABLE = 1 << 9, 1 << 20
#: Bytes of the rows that are sorted by token at once.
RUN = 1 << 25
#: A place in a segment is 16 bits.
SCHEMA = "table_name string, token string, segment long, n long, docs binary, tfs binary, blocks binary, starts binary, corners binary, most binary, least binary"
NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]
#: One row group a file, so that no file is cut between tasks; small pages, so that few are read for a token.
OPTIONS = {"parquet.block.size": str(1 << 30), "parquet.page.row.count.limit": "512", "parquet.page.size": str(1 << 16)}


def sliced(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values from stretches of an array."""
    offsets = (bounds * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def segment(table: str, number: int, ids: np.ndarray, lens: np.ndarray | None, tokens: pa.ListArray, corners: bool = True) -> pa.RecordBatch:
    """The rows of a segment; without corners none of its lists have any, without lens a document's length is its distinct tokens."""
    sizes = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(tokens).dictionary_encode()
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) << 16 | np.repeat(np.arange(len(ids)), sizes)
    if lens is None and (blank := coded.dictionary.index("").as_py()) >= 0:
        key = key[key >> 16 != blank]  # what a cut leaves before and after a text
    key, tf = np.unique(key, return_counts=True)
    code, doc, tf = key >> 16, (key & 0xFFFF).astype(np.uint16), tf.astype(np.uint32)
    lens = np.bincount(doc, minlength=len(ids)).astype(np.int32) if lens is None else lens
    first = np.flatnonzero(np.diff(code, prepend=-1))
    by_doc = np.append(first, len(doc))
    counts = np.diff(by_doc)
    long = np.flatnonzero(np.repeat((counts > BLOCK) & corners, counts))
    of = np.repeat(np.arange(len(first)), counts)[long]
    at, often, length = doc[long], tf[long], lens[doc[long]]
    block = at >> 6
    enters = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(block.astype(np.int64), prepend=-1) != 0))
    entry = np.searchsorted(enters, np.arange(len(at)), "right") - 1
    if len(at) and max(length.max(), often.max()) < 1 << 20 and len(enters) < 1 << 23:  # in one number
        order = np.argsort(entry << 40 | ((1 << 20) - often.astype(np.int64)) << 20 | length)
    else:
        order = np.lexsort((length, -often.astype(np.int64), entry))
    sorted_by = length[order].astype(np.int64)
    shortest = np.minimum.accumulate(sorted_by - (entry[order] << 32)) + (entry[order] << 32) if len(order) else sorted_by  # so far in the block, as each block begins anew
    corner = np.ones(len(order), bool)
    corner[1:] = (entry[order][1:] != entry[order][:-1]) | (sorted_by[1:] < shortest[:-1])
    most, least, corners_at = often[order][corner], length[order][corner], np.searchsorted(entry[order][corner], np.arange(len(enters)))
    by_block = np.searchsorted(of[enters], np.arange(len(first) + 1))
    starts = (long[enters] - first[of[enters]]).astype(np.uint32)
    by_corner = np.append(corners_at, len(most))[by_block]
    inside = (corners_at - by_corner[of[enters]]).astype(np.uint32)
    m = len(first)
    lists = [coded.dictionary.take(pa.array(code[first])), pa.array(counts), sliced(doc, by_doc), sliced(tf, by_doc), sliced(block[enters].astype(np.uint16), by_block), sliced(starts, by_block), sliced(inside, by_block), sliced(most, by_corner), sliced(least, by_corner)]
    documents = ["", len(ids), ids.tobytes(), lens.tobytes(), *[b""] * 5]
    columns = [pa.concat_arrays([pa.array([d], c.type), c]) for d, c in zip(documents, lists)]
    return pa.RecordBatch.from_arrays([pa.array([table] * (m + 1)), columns[0], pa.array([number] * (m + 1)), *columns[1:]], names=NAMES)


def packed(docs: DataFrame, grams: Callable[[pa.Array], pa.ListArray] | None = None, corners: bool = True) -> DataFrame:
    """The rows of documents (table_name, id, tokens, len), by token in each run. grams: makes the tokens of a batch from the column, else they are arrays, or texts of words with white space between.

    Without a column len a document's length is that of its distinct tokens, and the empty token is none.
    """
    given = "len" in docs.columns
    grams = pc.ascii_split_whitespace if grams is None and dict(docs.dtypes)["tokens"] == "string" else grams

    def run(batches):
        from pyspark import TaskContext

        number, name, ids, lens, tokens, size, held = TaskContext.get().partitionId() << 24, None, [], [], [], 0, []

        def flush():
            nonlocal number, ids, lens, tokens, size
            if ids:
                own = pa.concat_arrays(tokens) if len(tokens) > 1 else tokens[0]
                held.append(segment(name, number, np.concatenate(ids), np.concatenate(lens) if given else None, own, corners))
                number, ids, lens, tokens, size = number + 1, [], [], [], 0
                if sum(b.nbytes for b in held) >= RUN:
                    yield from in_order()

        def in_order():
            if held:
                rows = pa.Table.from_batches(held).combine_chunks()  # else each take puts them together anew
                held.clear()
                order = pc.sort_indices(rows.select(["token", "segment"]), sort_keys=[("token", "ascending"), ("segment", "ascending")])
                for lo in range(0, len(order), 10_000):
                    yield from rows.take(order.slice(lo, 10_000)).combine_chunks().to_batches()

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                table = some.column("table_name")[0].as_py()
                split = [k for k, t in enumerate(some.column("table_name").to_pylist()) if t != table]
                for part in [some] if not split else [some.slice(k, 1) for k in range(some.num_rows)]:
                    if (own := part.column("table_name")[0].as_py()) != name:
                        yield from flush()
                        name = own
                    words = part.column("tokens") if grams is None else grams(part.column("tokens"))
                    ids.append(part.column("id").to_numpy(zero_copy_only=False).astype(np.int64))
                    if given:
                        lens.append(part.column("len").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32))
                    tokens.append(words)
                    size += len(pc.list_flatten(words))
                    if size >= TOKENS or sum(map(len, ids)) >= DOCUMENTS:
                        yield from flush()
        yield from flush()
        yield from in_order()

    return docs.select("table_name", "id", "tokens", *[F.col("len").cast("int").alias("len")] * given).mapInArrow(run, SCHEMA)


def write(docs: DataFrame, path: str, grams=None, corners: bool = True) -> None:
    """Documents of fewer files than cores are dealt to all cores first."""
    n = docs.sparkSession.sparkContext.defaultParallelism
    if len(docs.inputFiles()) < n:
        docs = docs.repartition(n, "id")
    packed(docs, grams, corners).write.options(**OPTIONS).mode("overwrite").parquet(path)


class Lists:
    """What a task holds of a query's tokens: the documents of each segment and the lists of its tokens."""

    def __init__(self, batches):
        self.documents, self.rows = {}, {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["token"] == "":
                    self.documents[r["segment"]] = r["table_name"], np.frombuffer(r["docs"], np.int64), np.frombuffer(r["tfs"], np.int32)
                elif r["segment"] not in self.documents:
                    raise ValueError("a file of posting lists was cut between tasks: its row group is larger than its option says")
                else:
                    self.rows.setdefault(r["segment"], {})[r["token"]] = r

    def __iter__(self):
        for number, rows in self.rows.items():
            yield *self.documents[number], rows


def places(row: dict) -> np.ndarray:
    return np.frombuffer(row["docs"], np.uint16)


def counts(row: dict) -> np.ndarray:
    return np.frombuffer(row["tfs"], np.uint32).astype(np.int64)


def blocks_of(row: dict, lens: np.ndarray) -> tuple[np.ndarray, ...]:
    """blocks, starts, corners, most, least of a list; those of a list without corners are its own numbers."""
    if row["blocks"]:
        return tuple(np.frombuffer(row[c], t) for c, t in (("blocks", np.uint16), ("starts", np.uint32), ("corners", np.uint32), ("most", np.uint32), ("least", np.int32)))
    at = places(row)
    starts = np.flatnonzero(np.diff(at >> 6, prepend=np.uint16(0xFFFF)))
    return at[starts] >> 6, starts, starts, counts(row), lens[at]


def selected(rows: DataFrame, words: list[str], table: str | None) -> DataFrame:
    rows = rows.where(F.col("token").isin(["", *words]))
    return rows if table is None else rows.where(F.col("table_name") == table)


def decoded(rows: DataFrame, empty: str | None = None) -> DataFrame:
    """table_name, id, token, tf, len of all lists, of selected or all tokens; a file's ids come before its lists. empty: a token that each document gets besides."""
    out = "table_name string, id long, token string, tf long, len int"

    def run(batches):
        documents = {}
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                if r["token"] == "":
                    documents[r["segment"]] = ids, lens = np.frombuffer(r["docs"], np.int64), np.frombuffer(r["tfs"], np.int32)
                    if empty is not None:
                        made.append((r["table_name"], empty, ids, np.ones(len(ids), np.int64), lens))
                else:
                    (ids, lens), at = documents[r["segment"]], places(r)
                    made.append((r["table_name"], r["token"], ids[at], counts(r), lens[at]))
            for lo in range(0, len(made), 2000):
                some = made[lo : lo + 2000]
                sizes = [len(m[2]) for m in some]
                text = lambda k: pa.array([m[k] for m in some], pa.string()).take(pa.array(np.repeat(np.arange(len(some)), sizes)))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([text(0), pa.array(np.concatenate([m[2] for m in some])), text(1), pa.array(np.concatenate([m[3] for m in some])), pa.array(np.concatenate([m[4] for m in some]))], names=["table_name", "id", "token", "tf", "len"])

    return rows.select("table_name", "token", "segment", "docs", "tfs").mapInArrow(run, out)


def matching(rows: DataFrame, words: list[str], table: str | None) -> DataFrame:
    """id of the documents that have all the words; the lists are intersected in each segment, the shortest first."""

    def run(batches):
        for _, ids, _, own in Lists(batches):
            if len(own) == len(words):
                lists = sorted((places(r) for r in own.values()), key=len)
                found = lists[0]
                for other in lists[1:]:
                    found = np.intersect1d(found, other, assume_unique=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids[found])], names=["id"])

    return selected(rows, words, table).select("table_name", "token", "segment", "docs", "tfs").mapInArrow(run, "id long")


class Weights:
    """BM25 of a term: idf by word, and what lengths add."""

    def __init__(self, idf: dict[str, float], avglen: float, k1: float, b: float):
        self.idf, self.avglen, self.k1, self.b = idf, avglen, round(k1, 6), round(b, 6)

    def factor(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        if not self.avglen:
            return np.zeros(len(tf))
        return (tf * round(self.k1 + 1, 6)) / (tf + self.k1 * (1 - self.b + self.b * length / self.avglen))

    def term(self, word: str, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf[word] * self.factor(tf, length)


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def scored(rows: DataFrame, weights: Weights, table: str | None, only: list[int] | None = None) -> DataFrame:
    """id, score of all documents that have a word, or of those among them with these ids."""

    def run(batches):
        for _, ids, lens, own in Lists(batches):
            total, has = np.zeros(len(ids)), np.zeros(len(ids), bool)
            for word in weights.idf:
                if (r := own.get(word)) is not None:
                    at = places(r)
                    total[at] += weights.term(word, counts(r), lens[at])
                    has[at] = True
            if only is not None:
                has &= np.isin(ids, only)
            at = np.flatnonzero(has)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(total[at])], names=["id", "score"])

    return selected(rows, list(weights.idf), table).select("table_name", "token", "segment", "docs", "tfs").mapInArrow(run, "id long, score double")


def tops(rows: DataFrame, weights: Weights, table: str | None, k: int, digits: int = 6) -> DataFrame:
    """The best k of each task by score, then id, both descending; and how many blocks its lists have and how many of them were read.

    Blocks are taken by the largest score that their words' largest weights allow, until none can reach the k-th best so far.
    """

    def run(batches):
        parts, lists = [], list(Lists(batches))
        for number, (_, _, lens, own) in enumerate(lists):
            bound: dict[int, float] = {}
            for word, r in own.items():
                blocks, starts, corners, most, least = blocks_of(r, lens)
                r["entered"] = blocks, starts
                largest = np.maximum.reduceat(weights.term(word, most.astype(np.int64), least), corners)
                for block, x in zip(blocks.tolist(), largest.tolist()):
                    bound[block] = bound.get(block, 0.0) + x
            parts += [(x, number, block) for block, x in bound.items()]
        parts.sort(reverse=True)
        best, least, read, slack = [], -1.0, 0, 10.0**-digits
        for x, number, block in parts:
            if len(best) >= k and x + slack < least:
                break
            read += 1
            _, ids, lens, own = lists[number]
            base = block * BLOCK
            total, has = np.zeros(BLOCK), np.zeros(BLOCK, bool)
            for word in weights.idf:
                if (r := own.get(word)) is None:
                    continue
                blocks, starts = r["entered"]
                at = int(np.searchsorted(blocks, block))
                if at == len(blocks) or blocks[at] != block:
                    continue
                lo, hi = int(starts[at]), int(starts[at + 1]) if at + 1 < len(starts) else r["n"]
                doc = np.frombuffer(r["docs"], np.uint16, hi - lo, 2 * lo)
                tf = np.frombuffer(r["tfs"], np.uint32, hi - lo, 4 * lo).astype(np.int64)
                total[doc - base] += weights.term(word, tf, lens[doc])
                has[doc - base] = True
            some = np.flatnonzero(has)
            best += zip(np.round(total[some], digits).tolist(), ids[base + some].tolist(), total[some].tolist())
            if len(best) > k:
                best = sorted(best, reverse=True)[:k]
            least = best[-1][0] if len(best) == k else -1.0
        best.sort(reverse=True)
        rows = [(i, s, None, None) for _, i, s in best] + [(None, None, len(parts), read)] * bool(parts)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["id", "score", "blocks", "blocks_read"])

    return selected(rows, list(weights.idf), table).mapInArrow(run, "id long, score double, blocks long, blocks_read long")


class Asked:
    """Many queries as arrays: pairs of a query and a word it has, a query's most frequent words first."""

    def __init__(self, queries: list[tuple[int | None, list[str]]], frequency: dict[str, int], seeds: int | None = None):
        number = {w: k for k, w in enumerate(sorted(frequency))}
        sizes = np.array([len(own) for _, own in queries], np.int64)
        word = np.fromiter((number[w] for _, own in queries for w in own), np.int32, int(sizes.sum()))
        self._order([q for q, _ in queries], sorted(number), np.repeat(np.arange(len(queries), dtype=np.int32), sizes), word, np.array([frequency[w] for w in sorted(number)], np.int64), seeds)

    @classmethod
    def of(cls, ids: list[int | None], words: list[str], query: np.ndarray, word: np.ndarray, df: np.ndarray, seeds: int | None = None) -> Asked:
        """From pairs of a query's and a word's number, the queries ascending."""
        out = cls.__new__(cls)
        out._order(ids, words, query, word, df, seeds)
        return out

    def _order(self, ids, words, query, word, df, seeds) -> None:
        order = np.lexsort((word, -df[word], query))
        self.ids, self.words, self.query, self.word = ids, words, query, word[order]
        self.first = np.searchsorted(query, np.arange(len(ids) + 1)).astype(np.int32)
        n = df[self.word]
        rarer = np.cumsum(n[::-1])[::-1] - n  # documents of the words after this one, later queries' too
        after = np.append(rarer + n, 0)[self.first[1:]]
        self.share = np.clip((max(seeds or 0, SEEDS) - (rarer - after[query])) / np.maximum(n, 1), 0, 1).astype(np.float32)  # of a word's documents that are looked at for the first bound


def runs(batches) -> Iterator[pa.Table]:
    """The rows of each run, in which the rows of its documents come first."""
    held, blank = [], True
    for batch in batches:
        if not batch.num_rows:
            continue
        is_blank = pc.equal(batch.column("token"), "").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(is_blank & ~np.append(blank, is_blank[:-1]))
        blank = is_blank[-1]
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if lo in cuts and held:
                yield pa.Table.from_batches(held)
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def flat(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column one after the other, and where each row's begin."""
    parts = [c.cast(pa.binary()) for c in column.chunks if len(c)]
    bounds = [np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1] for c in parts]
    data = [np.frombuffer(c.buffers()[2], np.uint8)[b[0] : b[-1]] for c, b in zip(parts, bounds) if b[-1] > b[0]]
    sizes = np.concatenate([np.zeros(1, np.int64), *[np.diff(b) for b in bounds]]).astype(np.int64)
    return (np.concatenate(data) if data else np.zeros(0, np.uint8)).view(dtype), np.cumsum(sizes) // np.dtype(dtype).itemsize


def stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each stretch."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def first_of(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, digits: int) -> np.ndarray:
    """The places of the best k of each query by rounded score, then id, both descending; the queries ascend."""
    order = np.lexsort((-ids, -np.round(scores, digits), query))
    own = query[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


class Segment:
    """The lists of a segment's words as arrays: rows of words, their documents' places ascending."""

    def __init__(self, lens: np.ndarray, sizes: np.ndarray, place: np.ndarray, tf: np.ndarray, idf: np.ndarray, weights: Weights):
        self.sizes, self.place, self.begin = sizes, place, np.cumsum(sizes) - sizes
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.factor, self.idf, self.stride = weights.factor(tf, lens[place]), idf, weights.k1 + 2
        self.largest = idf * np.maximum.reduceat(self.factor, self.begin)
        self.keys = self.row.astype(np.int64) << 16 | place
        frequent = 64 * sizes >= len(lens)  # words of many documents are looked up in a table of at most TABLE cells
        room = max(1, TABLE // len(lens))
        if frequent.sum() > room:
            frequent = sizes > np.partition(sizes, -room)[-room]
        self.full_of = np.where(frequent, np.cumsum(frequent) - 1, -1).astype(np.int32)
        some = np.flatnonzero(frequent[self.row])
        self.full = np.zeros((int(frequent.sum()), len(lens)))
        self.full[self.full_of[self.row[some]], place[some]] = idf[self.row[some]] * self.factor[some]

    def found(self, row: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the lists, and whether they are these rows' and documents'."""
        want = row.astype(np.int64) << 16 | doc
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return at, self.keys[at] == want

    def terms(self, row: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The weights of words in documents, 0 where they aren't there."""
        own = self.full_of[row]
        out = self.full[own, doc] if len(self.full) else np.zeros(len(row))
        rare = np.flatnonzero(own < 0)
        if len(rare):
            at, there = self.found(row[rare], doc[rare])
            out[rare] = np.where(there, self.idf[row[rare]] * self.factor[at], 0.0)
        return out

    def by_weight(self, rows: np.ndarray) -> None:
        """Sorts the lists of these rows by weight, the largest first."""
        asked = np.zeros(len(self.sizes), bool)
        asked[rows] = True
        some = np.flatnonzero(asked[self.row])
        key = self.row[some] * self.stride - self.factor[some]
        order = np.argsort(key)
        some = some[order]
        self.sorted_key, self.sorted_doc, self.sorted_term = key[order], self.place[some].astype(np.int32), self.idf[self.row[some]] * self.factor[some]
        ends = np.cumsum(np.where(asked, self.sizes, 0))
        self.sorted_begin = ends - np.where(asked, self.sizes, 0)

    def reaching(self, row: np.ndarray, factor: np.ndarray) -> np.ndarray:
        """How many documents of sorted rows have at least this factor, or a little less."""
        ends = np.searchsorted(self.sorted_key, row * self.stride - np.clip(factor - 1e-8, -1, self.stride), "right")
        return np.clip(ends - self.sorted_begin[row], 0, self.sizes[row])


def tops_many(rows: DataFrame, asked: Asked, weights: Weights, table: str, k: int, digits: int = 6, least: np.ndarray | None = None) -> DataFrame:
    """query_id, id, score: the best k of each task for each of many queries, by score, then id, both descending.

    rows: the lists of the queries' words. least: scores that k documents of the whole table reach for each query, or -inf. A document is looked at where it has the query's
    rarest word that it has at all. There the weights of the more frequent words can be no more than the segment's largest ones, so only documents at the head of the list, sorted by weight,
    can reach the score; these get the weights of the more frequent words one after the other, as long as they still can.
    Without `least` only some documents of each query's rarest words are looked at, about SEEDS in the whole table: what k of them reach is a bound for the second pass, no result.
    """
    seeding = least is None
    sent = rows.sparkSession.sparkContext.broadcast((asked, least))  # as many words as a block of queries has
    most = DENSE

    def run(batches):
        a, known = sent.value
        words, n_queries = pa.array(a.words, pa.string()), len(a.ids)
        idf_of = np.array([weights.idf[w] for w in a.words])
        least = np.full(n_queries, -np.inf) if known is None else known.copy()
        slack = 10.0**-digits
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        new, n_new = [], 0

        def settle():
            nonlocal best, new, n_new
            best = [np.concatenate([b, *[n[c] for n in new]]) for c, b in enumerate(best)]
            keep = first_of(*best, k, digits)
            best, new, n_new = [b[keep] for b in best], [], 0
            ends = np.flatnonzero(np.diff(best[0], append=-1))
            full = ends[np.diff(ends, prepend=-1) == k]
            if not seeding:
                least[best[0][full]] = np.maximum(least[best[0][full]], best[2][full])

        def candidates(own: Segment, row_of: np.ndarray, number: int):
            """query, place, score of the documents of a segment that can be among a query's best."""
            here = np.flatnonzero(row_of[a.word] >= 0)  # pairs whose word the segment has
            query, row = a.query[here], row_of[a.word[here]]
            first = np.searchsorted(query, np.arange(n_queries + 1)).astype(np.int32)
            before = np.append(0.0, np.cumsum(own.largest[row]))
            before = before[:-1] - before[first[:-1]][query]  # what a query's more frequent words add at most
            goal = least[query] - slack
            pairs = np.flatnonzero(a.share[here] > 0 if seeding else before + own.largest[row] >= goal)
            if not len(pairs):
                return
            own.by_weight(np.unique(row[pairs]))
            if seeding:
                part = (pairs * 0.6180339887 + number * 0.7548776662) % 1
                n = np.minimum((a.share[here[pairs]] * own.sizes[row[pairs]] + part).astype(np.int64), own.sizes[row[pairs]])
            else:
                n = own.reaching(row[pairs], (goal[pairs] - before[pairs]) / own.idf[row[pairs]])
            pairs, n = pairs[n > 0].astype(np.int32), n[n > 0]
            sums, lo = np.append(0, np.cumsum(n)), 0
            while lo < len(pairs):
                hi = max(lo + 1, int(np.searchsorted(sums, sums[lo] + most, "right")) - 1)
                at = stretches(own.sorted_begin[row[pairs[lo:hi]]], n[lo:hi])
                pair, doc, total, step = np.repeat(pairs[lo:hi], n[lo:hi]), own.sorted_doc[at], own.sorted_term[at], 0
                lo, done = hi, []
                while len(pair):
                    step += 1
                    other = pair - step
                    ended = other < first[query[pair]]
                    if ended.any():
                        done.append((pair[ended], doc[ended], total[ended]))
                        pair, doc, total, other = pair[~ended], doc[~ended], total[~ended], other[~ended]
                    total = total + own.terms(row[other], doc)
                    if not seeding:
                        able = np.flatnonzero(total + before[other] >= goal[pair])
                        pair, doc, total = pair[able], doc[able], total[able]
                pair, doc, total = (np.concatenate(x) for x in zip(*done)) if done else (pair, doc, total)
                step, rarer = 0, np.arange(len(pair))
                alone = total >= goal[pair]
                while len(rarer):  # a document with a rarer word of the query is looked at there
                    step += 1
                    rarer = rarer[alone[rarer] & (pair[rarer] + step < first[query[pair[rarer]] + 1])]
                    alone[rarer] = ~own.found(row[pair[rarer] + step], doc[rarer])[1]
                yield query[pair[alone]].astype(np.int64), doc[alone], total[alone]

        for own in runs(batches):
            number = own.column("segment").to_numpy()
            of_word = pc.fill_null(pc.index_in(own.column("token"), value_set=words), -1).to_numpy()
            blank = pc.equal(own.column("token"), "").to_numpy()
            places_of, where = flat(own.column("docs").filter(pa.array(~blank)), np.uint16)
            counts_of, _ = flat(own.column("tfs").filter(pa.array(~blank)), np.uint32)
            listed, listed_word = number[~blank], of_word[~blank]
            documents = {r["segment"]: r for r in own.filter(pa.array(blank)).select(["segment", "docs", "tfs"]).to_pylist()}
            if len(np.setdiff1d(listed, np.array(list(documents), np.int64))):
                raise ValueError("a file of posting lists was cut between tasks: its row group is larger than its option says")
            for segment_number, r in documents.items():
                ids, lens = np.frombuffer(r["docs"], np.int64), np.frombuffer(r["tfs"], np.int32)
                mine = np.flatnonzero((listed == segment_number) & (listed_word >= 0))
                if not len(mine):
                    continue
                sizes = where[mine + 1] - where[mine]
                at = stretches(where[mine], sizes)
                place, tf, word = places_of[at].astype(np.int64), counts_of[at].astype(np.int64), np.repeat(listed_word[mine].astype(np.int64), sizes)
                parts, by_length = 1, np.arange(len(lens))
                if not seeding:
                    parts, by_length, rank = max(1, len(lens) // PART), np.argsort(lens, kind="stable"), np.empty(len(lens), np.int64)
                    rank[by_length] = np.arange(len(lens))
                    place = rank[place]
                key = (place * parts // len(lens)) << 48 | word << 16 | place
                if not seeding or (np.diff(listed_word[mine]) < 0).any():
                    order = np.argsort(key)
                    key, tf = key[order], tf[order]
                bounds = np.searchsorted(key, np.arange(parts + 1) << 48)
                for which in range(parts):
                    lo, hi = bounds[which], bounds[which + 1]
                    if lo == hi:
                        continue
                    base, end = -(-which * len(lens) // parts), -(-(which + 1) * len(lens) // parts)
                    own_word = key[lo:hi] >> 16 & 0xFFFFFFFF
                    begin = np.flatnonzero(np.diff(own_word, prepend=-1))
                    row_of = np.full(len(words), -1, np.int32)
                    row_of[own_word[begin]] = np.arange(len(begin))
                    lists = Segment(lens[by_length[base:end]], np.diff(np.append(begin, hi - lo)), (key[lo:hi] & 0xFFFF) - base, tf[lo:hi], idf_of[own_word[begin]], weights)
                    for query, doc, total in candidates(lists, row_of, segment_number):
                        new.append((query, ids[by_length[base + doc]], total))
                        n_new += len(query)
                        if n_new > max(k * n_queries, 1 << 17):
                            settle()
        settle()
        for lo in range(0, len(best[0]), 1 << 14):
            q, i, s = (b[lo : lo + (1 << 14)] for b in best)
            yield pa.RecordBatch.from_arrays([pa.array([a.ids[x] for x in q.tolist()], pa.int64()), pa.array(i), pa.array(s)], names=["query_id", "id", "score"])

    return rows.where(F.col("table_name") == table).select("table_name", "token", "segment", "docs", "tfs").mapInArrow(run, "query_id long, id long, score double")
