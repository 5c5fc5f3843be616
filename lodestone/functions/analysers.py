"""Analysers by language: the terms of a text with their positions, for documents in Arrow workers and for queries alike.

english: Porter2 stems without stop words. korean: pieces by a learned lexicon without postpositions. simple: the words as they are.
A term's position counts stop words and stop pieces too, so phrases keep their distances.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segmentation, stemming
from . import text as T

Terms = Callable[[Iterable[str]], list[str | None]]
#: Words that a worker lays out at once; a longer document makes a batch of its own.
WORDS = 1 << 18


def cut(batches, column: str = "tokens", most: int = WORDS):
    """Record batches again, each with about that many values in the list column at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.list_value_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


class Placed:
    """The terms of a batch's rows. Each distinct word is analysed once; term: different terms; row, code, place (from 1, stop words count): of each that stands somewhere."""

    def __init__(self, tokens: pa.ListArray, terms: Terms):
        sizes = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = pc.list_flatten(tokens).dictionary_encode()
        found, codes, made = {}, [], []
        for word in words.dictionary.to_pylist():
            own = terms((word,))
            made.append(len(own))
            codes += [found.setdefault(t, len(found)) if t else -1 for t in own]
        codes, made = np.array(codes, np.int64), np.array(made, np.int64)
        at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = made[at]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        code = codes[np.repeat((np.cumsum(made) - made)[at], n) + inside]
        row = np.repeat(np.repeat(np.arange(len(sizes)), sizes), n)
        place = np.arange(len(row)) - np.searchsorted(row, row) + 1
        kept = code >= 0
        self.term, self.row, self.code, self.place = pa.array(list(found), pa.string()), row[kept], code[kept], place[kept]

    def groups(self) -> tuple[np.ndarray, pa.Array, pa.ListArray, np.ndarray]:
        """row, term, places and number of each row's different terms."""
        key = self.row * max(len(self.term), 1) + self.code
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        ends = np.append(first, len(order))
        places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(self.place[order], pa.int32()))
        return self.row[order][first], self.term.take(pa.array(self.code[order][first])), places, np.diff(ends)


def placed_rows(b: pa.RecordBatch, terms: Terms, name: str) -> Iterable[pa.RecordBatch]:
    row, term, places, n = Placed(b.column("tokens"), terms).groups()
    if len(row):
        yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), term, places, pa.array(n, pa.int64())], names=["id", name, "positions", "tf"])


def english() -> Terms:
    return lambda words: [None if w in stemming.STOP_WORDS else stemming.stem(w) for w in words]


def simple() -> Terms:
    return lambda words: list(words)


class Analyser:
    """An analyser of a language; korean needs its lexicon. Both documents and queries go through it."""

    def __init__(self, language: str, lexicon: segmentation.Lexicon | None = None, pattern: str = segmentation.HANGUL, stop: Iterable[str] = T.POSTPOSITIONS):
        if language not in ("english", "korean", "simple"):
            raise ValueError(f"no analyser for {language!r}")
        if (language == "korean") != (lexicon is not None):
            raise ValueError("a lexicon belongs to korean, and only to it")
        self.language, self.lexicon, self.pattern, self.stop = language, lexicon, pattern, tuple(stop)

    def terms(self) -> Terms:
        """Made in the worker: words to terms, None where a stop word is passed over."""
        if self.language == "korean":
            return segmentation.Cutter(self.lexicon, self.pattern, self.stop).terms
        return english() if self.language == "english" else simple()

    def query(self, text: str) -> list[str]:
        """A query's terms in order, each once."""
        return list(dict.fromkeys(t for t in self.terms()(T.words_of(text)) if t))

    def _map(self, df: DataFrame, rows, schema: str) -> DataFrame:
        make = df.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            terms = make.value.terms()
            for b in cut(batches):
                yield from rows(b, terms)

        return df.mapInArrow(run, schema)

    def analysed(self, df: DataFrame, table: str, id_col: str = "id", text_col: str = "content") -> DataFrame:
        """table_name, id, tokens, len, as the index builds read them; len counts distinct terms. No shuffle; null texts have no terms."""

        def rows(b, terms):
            found = Placed(b.column("tokens"), terms)
            ends = np.searchsorted(found.row, np.arange(b.num_rows + 1))
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found.term.take(pa.array(found.code)))
            sizes = pa.array(np.bincount(found.groups()[0], minlength=b.num_rows), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([table] * b.num_rows), b.column("id"), tokens, sizes], names=["table_name", "id", "tokens", "len"])

        some = df.select(F.col(id_col).cast("long").alias("id"), T.tokens(F.col(text_col)).alias("tokens"))
        return self._map(some, rows, "table_name string, id long, tokens array<string>, len int")

    def positions(self, df: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
        """id, term, positions (from 1), tf of each document's terms. A document's words are in its row, so nothing is shuffled."""
        some = df.select(F.col(id_col).cast("long").alias("id"), T.tokens(F.col(text_col)).alias("tokens"))
        return self._map(some, lambda b, terms: placed_rows(b, terms, "term"), "id long, term string, positions array<int>, tf long")

    def phrase(self, df: DataFrame, text: str, id_col: str = "id", text_col: str = "content") -> DataFrame:
        """id, n: how often the query's terms stand in a document at the distances they have in the query. A query without terms finds nothing; repeated ids count as one document each."""
        want = [(t, k) for k, t in enumerate(self.terms()(T.words_of(text))) if t]

        def rows(b, terms):
            ids, counts = [], []
            for i, words in zip(b.column("id").to_pylist(), b.column("tokens").to_pylist()):
                at: dict[str, set[int]] = {t: set() for t, _ in want}
                for k, t in enumerate(terms(words or ())):
                    if t in at:
                        at[t].add(k)
                starts = set.intersection(*({p - k for p in at[t]} for t, k in want)) if want else ()
                if starts:
                    ids.append(i)
                    counts.append(len(starts))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], names=["id", "n"])

        some = df.select(F.col(id_col).cast("long").alias("id"), T.tokens(F.col(text_col)).alias("tokens"))
        return self._map(some, rows, "id long, n long")
