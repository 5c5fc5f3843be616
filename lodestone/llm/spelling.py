"""Spelling variants: words that differ by one edit, grouped under the frequent form that they vary.

1. Runs of letters of whole texts are counted in the workers; sums go out when a worker's table is full, and Spark adds them up.
2. Even-partition pigeonhole join: a word of length l is indexed by two segments, its halves. A word that differs by one
   edit keeps one of them whole. So the other word, of equal or one more letters, is probed by its substrings of the
   segments' lengths: at the start, and at the end (shifted by one in the longer word). A segment's key is all of the
   word but the other half.
3. Keys that more than CROWDED words have (by a count sketch of fixed size) aren't joined: the half where the edit must
   be is cut in two once more, and its quarters are keys, and so on down to parts of two letters or a 16th. Both words of a
   pair decide by the same key, so no pair is lost; what is still together at the end differs in two letters at most. Where
   the vocabulary outgrows the sketch, every key counts as crowded, and each word has at most 16 keys and 16 probes.
4. A pair with one letter inserted can be found at several keys; it counts at the part in which the two words first
   differ only, so candidates are never doubled, and need no shuffle to tell. Each is verified (one edit).
5. A word's form is its most frequent near word if that has `times` its count; roots follow forms to the last, a few
   joins, as counts grow by that factor with each step.

Defined results: null and empty texts have no words; repeated rows count again, with the same letter left out of the
same run (which depends on id and run only); a null id counts as an empty one; letters beyond A-Z are not
lower-cased; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sums
from .runtime import cut, documents, drop, shared_dir, written

LETTERS = "A-Za-zÀ-ÿ"
#: Words that a worker counts before it gives them on.
TABLE = 200_000
#: One run in so many has a letter left out.
DROPPED = 31
LEVELS = 4
SLOTS = 1 << 20
CROWDED = 16


def runs_of(text: str | None, doc_id: int | None, pattern: re.Pattern, least: int) -> Counter:
    """The runs of a text with their counts, as they count as words."""
    out: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(pattern.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
        h = zlib.crc32(run.encode(), start)
        if h % DROPPED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= least:
            out[run] += n
    return out


def count_words(df: DataFrame, least: int = 7, occurrences: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of the words of at least so many letters and occurrences."""

    def run(batches):
        pattern, total = re.compile(f"[{LETTERS}]{{{least},}}"), Counter()
        for batch in cut(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                total.update(runs_of(text, doc_id, pattern, least))
                if len(total) >= TABLE:
                    yield given(total)
                    total = Counter()
        if total:
            yield given(total)

    def given(total):
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return documents(df, id_col, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


@lru_cache(None)
def parts(a: int, b: int, level: int) -> tuple[tuple[int, int], ...]:
    """The halves of a part; none if it is one of the last."""
    mid = a + (b - a) // 2
    return () if level and (b - a <= 2 or level == LEVELS) else ((a, mid), (mid, b))


def key(word: str, a: int, b: int, longer: int) -> int:
    """64 bits of a word without its letters from a to b, and of its length; the longer word of a pair has one more letter there."""
    import xxhash

    return xxhash.xxh64_intdigest(f"{len(word) - longer}\0{word[:a]}\0{word[b + longer:]}".encode("utf-8", "surrogatepass"))


def sketched(words: DataFrame) -> np.ndarray:
    """How many words have each slot's keys, on each level that can be cut further."""

    def run(batches):
        counts = np.zeros((LEVELS - 1) * SLOTS, np.uint32)
        for batch in batches:
            at = []
            for word in batch.column("word").to_pylist():
                some = parts(0, len(word), 0)
                for level in range(1, LEVELS):
                    some = [(a, b) for a, b in some if parts(a, b, level)]
                    at += [(level - 1) * SLOTS + (key(word, a, b, 0) >> 44) for a, b in some]
                    some = [p for a, b in some for p in parts(a, b, level)]
            np.add.at(counts, at, 1)
        if (made := sums.packed(counts)) is not None:
            yield made

    return sums.summed(words.mapInArrow(run, sums.PARTS), (LEVELS - 1) * SLOTS)


def segments(words: DataFrame, crowded) -> DataFrame:
    """k, longer, a, b, word, n: each word under its keys, and as the longer of a pair under those of words with one letter less."""

    def of(word: str, longer: int):
        todo = [(a, b, 1) for a, b in parts(0, len(word) - longer, 0)]
        while todo:
            a, b, level = todo.pop()
            k = key(word, a, b, longer)
            if (more := parts(a, b, level)) and crowded.value[(level - 1) * SLOTS + (k >> 44)]:
                todo += [(*p, level + 1) for p in more]
            else:
                yield k - (1 << 64) if k >> 63 else k, longer, a, b

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                some = batch.slice(lo, 2000)
                rows = [(*s, i) for i, word in enumerate(some.column("word").to_pylist()) for longer in (0, 1) for s in of(word, longer)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns[:4], some.column("word").take(columns[4]), some.column("n").take(columns[4])], names=["k", "longer", "a", "b", "word", "n"])

    return words.mapInArrow(run, "k long, longer int, a int, b int, word string, n long")


def near(words: DataFrame, folder: str) -> DataFrame:
    """s, sn, r, rn: each pair of near words once, with their counts."""
    crowded = words.sparkSession.sparkContext.broadcast(sketched(words) > CROWDED)
    every = written(segments(words, crowded), f"{folder}/segments")
    s = every.where("longer = 0").select("k", "a", "b", F.col("word").alias("s"), F.col("n").alias("sn"))
    r = every.select("k", "longer", F.col("word").alias("r"), F.col("n").alias("rn"))
    both = s.join(r.hint("merge"), "k").where("longer = 1 AND length(r) = length(s) + 1 OR longer = 0 AND s < r AND length(r) = length(s)")
    once = "longer = 0 OR b = length(s) OR substring(s, a + 1, b - a) <> substring(r, a + 1, b - a)"
    return both.where(once).where(F.levenshtein("s", "r", 1) == 1).select("s", "sn", "r", "rn")


def variants(df: DataFrame, least: int = 7, occurrences: int = 2, times: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    folder = shared_dir(df.sparkSession, "spelling")
    words = written(count_words(df, least, occurrences, id_col, text_col), f"{folder}/words")
    pairs = near(words, folder)
    side = lambda w, n, o, m: F.struct(F.col(w).alias("word"), F.when(F.col(m) >= times * F.col(n), F.struct((-F.col(m)).alias("m"), F.col(o).alias("o"))).alias("best"))
    found = pairs.select(F.inline(F.array(side("s", "sn", "r", "rn"), side("r", "rn", "s", "sn")))).groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    found = written(found.select("word", "n_near", F.col("best.o").alias("form"), (-F.col("best.m")).alias("form_n")), f"{folder}/found")
    forms = found.where("form IS NOT NULL").select(F.col("word").alias("before"), F.col("form").alias("next"))
    roots, step = found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), 0
    while True:  # counts grow by `times` a step
        last, step = roots, step + 1
        roots = last.join(forms.hint("merge"), F.col("root") == F.col("before"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        roots = written(roots, f"{folder}/roots-{step}")
        if roots.where("moved").isEmpty():
            break
    out = words.join(found.hint("merge"), "word", "left").join(roots.select("word", "root").hint("merge"), "word", "left")
    out = written(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"), f"{folder}/result")
    drop(df.sparkSession, *(f"{folder}/{t}" for t in ("words", "segments", "found")), *(f"{folder}/roots-{k}" for k in range(1, step + 1)))
    return out
