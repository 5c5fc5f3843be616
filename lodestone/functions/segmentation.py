"""Words cut into pieces on a lattice, by a unigram lexicon learned from all documents' words. For languages that hang endings on words, as Korean does.

Learning goes by description length over the distinct words (each counts once, so that a frequent inflected word doesn't stay whole for its
frequency): a piece costs -log of its share, and its spelling shared among its uses; letters that no piece covers are an unknown run, which is
spelled out where it stands. A round cuts all words by the best path and counts the pieces anew. Words are cut in Arrow workers, what a
round counts is summed by a shuffle of pieces, and only a lexicon of at most SIZE pieces goes to the driver and back to the workers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

#: Letters of a piece, pieces of a lexicon, at most.
PIECE, SIZE = 8, 1 << 16
#: Different pieces that a task counts before it hands them on.
HELD = 1 << 18
HANGUL = r"^[가-힣]+$"
LETTERS = r"^\p{L}+$"


@dataclass(frozen=True)
class Lexicon:
    """The cost of each piece, of opening an unknown run, and of a letter in it."""

    costs: dict[str, float]
    opening: float
    letter: float

    @staticmethod
    def counted(counts: dict[str, int], unknown: int, letters: int) -> Lexicon:
        """From how often pieces and unknown runs stand in the best paths. A piece that one word uses isn't kept."""
        kept = {p: n for p, n in counts.items() if n > 1}
        total, letter = sum(kept.values()) + max(unknown, 1), math.log(max(letters, 2))
        costs = {p: math.log(total / n) + (len(p) + 1) * letter / n for p, n in kept.items()}
        return Lexicon(costs, math.log(total / max(unknown, 1)) + letter, letter)

    @cached_property
    def ends(self) -> dict[str, tuple[int, ...]]:
        """The lengths of the pieces that end with two letters, the longest first: others needn't be looked up."""
        out: dict[str, set[int]] = {}
        for p in self.costs:
            if 1 < len(p) <= PIECE:
                out.setdefault(p[-2:], set()).add(len(p))
        return {two: tuple(sorted(sizes, reverse=True)) for two, sizes in out.items()}

    def cut(self, word: str) -> list[str]:
        """The cheapest path's pieces, in time linear in the word; equal costs go to known pieces, and to the longer last one."""
        return [word[a:b] for a, b, _ in self.path(word)]

    def path(self, word: str) -> list[tuple[int, int, bool]]:
        """(start, end, known) of the pieces."""
        n, find, ends = len(word), self.costs.get, self.ends.get
        cost, back = [0.0] * (n + 1), [(0, False)] * (n + 1)
        inside, since = math.inf, 0
        for i in range(1, n + 1):
            if cost[i - 1] + self.opening <= inside:
                inside, since = cost[i - 1] + self.opening, i - 1
            inside += self.letter
            least, at = math.inf, (0, False)
            for size in ends(word[i - 2 : i], ()) if i > 1 else ():
                if size <= i and (c := find(word[i - size : i])) is not None and cost[i - size] + c < least:
                    least, at = cost[i - size] + c, (i - size, True)
            if (c := find(word[i - 1])) is not None and cost[i - 1] + c < least:
                least, at = cost[i - 1] + c, (i - 1, True)
            cost[i], back[i] = (least, at) if least <= inside else (inside, (since, False))
        out, i = [], n
        while i:
            j, known = back[i]
            out.append((j, i, known))
            i = j
        return out[::-1]

    def frame(self, spark: SparkSession) -> DataFrame:
        """piece, cost: to be stored; the costs of unknown runs are rows without a piece."""
        rows = [*self.costs.items(), (None, self.opening), (None, self.letter)]
        return spark.createDataFrame([(k, p, c) for k, (p, c) in enumerate(rows)], "place long, piece string, cost double")

    @staticmethod
    def stored(df: DataFrame) -> Lexicon:
        rows = df.orderBy("place").collect()  # SIZE pieces at most
        opening, letter = [r.cost for r in rows if r.piece is None]
        return Lexicon({r.piece: r.cost for r in rows if r.piece is not None}, opening, letter)


def _counted(words: DataFrame, pieces) -> DataFrame:
    """piece, n: over all words what pieces(word) gives, counted in the tasks first."""

    def run(batches):
        held: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["piece", "n"])
            held.clear()

        for b in batches:
            for word in b.column(0).to_pylist():
                for p in pieces(word):
                    held[p] += 1
                    if len(held) >= HELD:
                        yield from out()
        if held:
            yield from out()

    return words.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def substrings(word: str) -> Iterator[str]:
    """Each of up to PIECE letters, once at each place."""
    for i in range(len(word)):
        for j in range(i + 1, min(i + PIECE, len(word)) + 1):
            yield word[i:j]


def learn(docs: DataFrame, tokens: Column, pattern: str = HANGUL, size: int = SIZE, rounds: int = 6) -> Lexicon:
    """A lexicon from the distinct words of all documents that match the pattern.

    Null and empty texts have no words; no words at all give a lexicon without pieces, which leaves every word whole. Repeated rows and the order of rows change nothing. First
    candidates are the `size` substrings that cover most letters, ties in code-point order.
    """
    if not 0 < size <= SIZE:
        raise ValueError(f"a lexicon has 1 to {SIZE} pieces")
    words = docs.select(F.explode(tokens).alias("word")).where(F.col("word").rlike(pattern)).distinct().persist()
    spark = docs.sparkSession
    try:
        all_pieces = _counted(words, substrings)
        letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").agg(F.countDistinct("c")).first()[0]
        first = all_pieces.where("n > 1").orderBy(F.desc(F.col("n") * F.length("piece")), "piece").limit(size).collect()
        lexicon = Lexicon.counted({r.piece: r.n for r in first}, 1, letters)
        for _ in range(rounds):
            shared = spark.sparkContext.broadcast(lexicon)

            def pieces(word, shared=shared):
                return [word[a:b] if known else "" for a, b, known in shared.value.path(word)]

            found = {r.piece: r.n for r in _counted(words, pieces).collect()}  # pieces of the lexicon, and unknown runs as one
            shared.destroy()
            lexicon = Lexicon.counted({p: n for p, n in found.items() if p}, found.get("", 0), letters)
        return lexicon
    finally:
        words.unpersist()


class Cutter:
    """Terms of words: pieces of those that match the pattern, without endings that are stop pieces; other words whole."""

    def __init__(self, lexicon: Lexicon, pattern: str = HANGUL, stop: Iterable[str] = T.POSTPOSITIONS):
        import regex

        self.lexicon, self.match, self.stop = lexicon, regex.compile(pattern).search, frozenset(stop)
        self.cut = lru_cache(1 << 17)(lambda w: tuple(lexicon.cut(w)))

    def terms(self, words: Iterable[str]) -> list[str | None]:
        """In order; None for a stop piece, which keeps its place. A word's first piece is never one."""
        out: list[str | None] = []
        for w in words:
            if not self.match(w):
                out.append(w)
                continue
            out += [None if k and p in self.stop else p for k, p in enumerate(self.cut(w))]
        return out
