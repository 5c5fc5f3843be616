"""Substring search over stored trigram posting lists of titles and contents.

A pattern's literal runs give its trigrams; the documents that have all of them are candidates, and only those are
fetched and tested. A pattern of just one trigram needs no test; one without (shorter than three characters) scans. Lists are
those of postings.py, so a search reads the pattern's lists where they lie. Changes are versions as in the
word index: a version holds the documents it brings and names those it replaces.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import postings as P

FIELDS = ("title", "content")
#: Candidates that are fetched by their ids; more are fetched by a join.
FETCHED = 2000


def grams(column: pa.Array) -> pa.ListArray:
    """The distinct trigrams of each text."""
    keys, sizes = [], [0]
    for text in column.to_pylist():
        c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        own = np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) if len(c) > 2 else np.zeros(0, np.int64)
        keys.append(own)
        sizes.append(len(own))
    every, at = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    mask = (1 << 21) - 1
    names = ["".join(map(chr, (k >> 42, k >> 21 & mask, k & mask))).encode("utf-8", "surrogatepass").decode("utf-8", "replace") for k in every.tolist()]
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(names, pa.string()).take(pa.array(at)))


def runs_of(pattern: str) -> list[str]:
    """The literal runs of a LIKE pattern, a backslash taking the next character as it is."""
    out, run = [], ""
    for m in re.finditer(r"\\(.)|[%_]|[^\\]", pattern, re.S):
        if m.group() in "%_":
            out, run = [*out, run], ""
        else:
            run += m.group(1) or m.group()
    return [r for r in [*out, run] if r]


def grams_of(pattern: str) -> list[str]:
    return list(dict.fromkeys(r[i : i + 3] for r in runs_of(pattern) for i in range(len(r) - 2)))


class Substrings:
    """folder/lists: the lists of versions, folder/dead: the ids that a version replaces."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _versions(self) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/done")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def write(self, docs: DataFrame, dead: DataFrame | None = None) -> int:
        """Documents (id, title, content) as the next version; dead: the ids (id) it replaces or deletes."""
        version = max(self._versions(), default=-1) + 1
        text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
        for field in FIELDS:  # a title is short, so it isn't dealt with the contents
            rows = docs.select(F.lit(field).alias("table_name"), F.col("id").cast("long").alias("id"), text(field).alias("tokens"), F.lit(0).alias("len"))
            P.write(rows, f"{self.folder}/lists/{field}/version={version}", grams, corners=False)
        words = docs.select(F.lit("words").alias("table_name"), F.col("id").cast("long").alias("id"), T.tokens(F.coalesce("title", F.lit(""))).alias("tokens"), F.lit(0).alias("len"))
        P.write(words, f"{self.folder}/lists/words/version={version}", corners=False)
        if dead is not None:
            dead.select(F.col("id").cast("long").alias("id")).distinct().write.mode("overwrite").parquet(f"{self.folder}/dead/version={version}")
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/done/{version}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(p, True).close()
        return version

    def candidates(self, field: str, pattern: str) -> DataFrame | None:
        """id of the documents that have all of the pattern's trigrams in the field; None if it has no trigram."""
        words = grams_of(pattern)
        return self._having(field, words) if words else None

    def title_words(self, words: list[str]) -> DataFrame:
        """id of the documents whose title has all the words; none for no words."""
        return self._having("words", list(dict.fromkeys(words))) if words else self.spark.createDataFrame([], "id long")

    def _having(self, field: str, words: list[str]) -> DataFrame:
        out, done = None, self._versions()
        for version in done:
            lists = self.spark.read.schema(P.SCHEMA).parquet(f"{self.folder}/lists/{field}/version={version}")
            found = P.matching(lists, words, field)
            for later in done:
                if later > version and self._has_dead(later):
                    found = found.join(self.spark.read.schema("id long").parquet(f"{self.folder}/dead/version={later}"), "id", "left_anti")
            out = found if out is None else out.unionByName(found)
        return out

    def _has_dead(self, version: int) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/dead/version={version}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def like(self, docs: DataFrame, field: str, pattern: str) -> DataFrame:
        """id of the documents whose lower-cased field is like the pattern. docs: id, title, content as they are now."""
        like = F.lower(F.coalesce(F.col(field), F.lit(""))).like(pattern)
        some = self.candidates(field, pattern)
        if some is None:
            return docs.where(like).select("id")
        if len(pattern) == 5 and pattern[0] == pattern[-1] == "%" and grams_of(pattern) == [pattern[1:-1]]:
            return some  # a trigram itself
        return fetched(docs, some).where(like).select("id")


def fetched(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids: few are asked for by id, which reaches the scan, more by a join."""
    few = ids.limit(FETCHED + 1).collect()
    return docs.where(F.col("id").isin([r.id for r in few])) if len(few) <= FETCHED else docs.join(ids.distinct(), "id", "left_semi")
