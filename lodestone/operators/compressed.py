"""Approximate nearest neighbours by inverted lists of product-quantised residuals, re-ranked exactly.

Centroids of the lists, and the code books of the residuals' parts, are fitted by k-means over all vectors: each
task sums up its own vectors by centroid, and only sums (a fixed number of them) come to the driver. A vector is
stored as its list and a byte for each part. A query's table of products with the code books gives the approximate
similarity of every code in its lists by look-ups (asymmetric distances); of the best few the vectors themselves are fetched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tiles
from .graph import FEW, Graphs

#: Lists, probed lists, numbers of a part, codes of a part, steps of each fit, vectors that a search fetches.
LISTS, PROBES, PART, CODES, STEPS, FETCHED = 32, 28, 4, 256, 6, 60
#: Vectors the first centroids are taken from, at most; the fit is over all.
SEEDS = 8192
#: Codes in a stored row.
PACK = 1 << 12
FOUND = "query_id long, id long, similarity double, codes long"


def closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = ((c * c).sum(1) - 2 * x[lo : lo + 4096] @ c.T).argmin(1)
    return out


def fitted(units: DataFrame, first: np.ndarray, parts) -> np.ndarray:
    """Centroids (part, centroid, numbers) after k-means over all vectors. parts(x): the vectors' parts, (part, n, numbers)."""
    c = first
    for _ in range(STEPS):
        now = c

        def sums(batches: Iterator[pa.RecordBatch]):
            total, count = np.zeros(now.shape), np.zeros(now.shape[:2], np.int64)  # noqa: B023
            for b in batches:
                for p, x in enumerate(parts(tiles.matrix(b.column("unit"), np.float64))):
                    own = closest(x, now[p])  # noqa: B023
                    np.add.at(total[p], own, x)
                    count[p] += np.bincount(own, minlength=now.shape[1])  # noqa: B023
            p, k = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(k), pa.array(count[p, k]), pa.array(list(total[p, k]), pa.list_(pa.float64()))], names=["p", "k", "n", "s"])

        added = units.select("unit").mapInArrow(sums, "p long, k long, n long, s array<double>").groupBy("p", "k").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(j))).alias(f"s{j}") for j in range(c.shape[2])])
        c = c.copy()
        for r in added.collect():  # a row a centroid
            c[r[0], r[1]] = np.array(r[3:]) / r[2]
    return c


class Compressed:
    """folder/codes: list, ids, codes (packed); folder/vectors: id, unit; folder/fit: the centroids and code books."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.schema("id long, unit array<float>").parquet(f"{self.folder}/vectors")

    @property
    def codes(self) -> DataFrame:
        return self.spark.read.schema("list int, ids binary, codes binary").parquet(f"{self.folder}/codes")

    def fit(self) -> tuple[np.ndarray, np.ndarray]:
        """(list, numbers) and (part, code, numbers)."""
        rows = {r.name: np.array(r.numbers).reshape(r.shape) for r in self.spark.read.parquet(f"{self.folder}/fit").collect()}
        return rows["lists"], rows["books"]

    def build(self, vectors: DataFrame, lists: int = LISTS, seed: int = 5) -> Compressed:
        Graphs.units(vectors).repartitionByRange("id").sortWithinPartitions("id").write.option("parquet.page.row.count.limit", "64").mode("overwrite").parquet(f"{self.folder}/vectors")
        units = self.vectors
        some = np.array([r.unit for r in units.orderBy(F.xxhash64(F.lit(seed), "id")).limit(SEEDS).collect()], np.float64)
        none = not len(some)
        some = np.zeros((1, PART)) if none else some
        c = fitted(units, some[: min(lists, len(some))][None], lambda x: x[None])[0]
        d = some.shape[1]
        edges = list(range(0, d, PART))
        rest = lambda x: x - c[closest(x, c)]
        pieces = lambda x: [np.pad(x[:, e : e + PART], ((0, 0), (0, PART - min(PART, d - e)))) for e in edges]
        first = np.stack([p[np.resize(np.arange(len(p)), CODES)] for p in pieces(rest(some))])
        books = fitted(units, first, lambda x: pieces(rest(x)))

        def encode(batches):
            for b in batches:
                x, ids = tiles.matrix(b.column("unit"), np.float64), b.column("id").to_numpy()
                own, r = closest(x, c), pieces(rest(x))
                code = np.stack([closest(p, books[k]) for k, p in enumerate(r)], 1).astype(np.uint8)
                rows = [(int(k), ids[at].tobytes(), code[at].tobytes()) for k in np.unique(own) for every in [np.flatnonzero(own == k)] for at in np.split(every, range(PACK, len(every), PACK))]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["list", "ids", "codes"])

        units.mapInArrow(encode, "list int, ids binary, codes binary").repartitionByRange("list").write.partitionBy("list").mode("overwrite").parquet(f"{self.folder}/codes")
        c = c[:0] if none else c
        fit = [("lists", list(c.shape), c.ravel().tolist()), ("books", list(books.shape), books.ravel().tolist())]
        self.spark.createDataFrame(fit, "name string, shape array<int>, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/fit")
        return self

    def candidates(self, queries: DataFrame, probes: int, fetched: int) -> DataFrame:
        """FOUND: of each query the best by approximate similarity, and how many codes it looked at."""
        c, books = self.fit()
        d = c.shape[1]
        edges = list(range(0, d, PART))

        def looked(lists, rows, names, q):
            """rows: (ids, codes) of a list; the queries that probe it."""
            tables = np.stack([np.pad(q[:, e : e + PART], ((0, 0), (0, PART - min(PART, d - e)))) @ books[k].T for k, e in enumerate(edges)])
            base, parts = q @ c[lists], []
            for ids, code in rows:
                s = sum(tables[k][:, code[:, k]] for k in range(len(edges))) + base[:, None]
                s[names[:, None] == ids[None, :]] = -np.inf
                r, at = tiles.smallest(-s, ids, fetched)
                parts.append((names[r], ids[at], s[r, at]))
            m = sum(len(ids) for ids, _ in rows)
            r, i, s = (np.concatenate(v) for v in zip(*parts))
            order = np.lexsort((i, -s, r))  # the best of all of the list's packs
            r, i, s = r[order], i[order], s[order]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < fetched
            r, i, s = r[keep], i[keep], s[keep]
            first = np.unique(r, return_index=True)[1]  # how many codes a query looked at here is told once
            n = np.zeros(len(r), np.int64)
            n[first] = m
            return pa.RecordBatch.from_arrays([pa.array(r), pa.array(i), pa.array(s), pa.array(n)], names=["query_id", "id", "similarity", "codes"])

        unpacked = lambda ids, codes: [(np.frombuffer(i, np.int64), np.frombuffer(x, np.uint8).reshape(-1, len(edges))) for i, x in zip(ids.to_pylist(), codes.to_pylist())]
        nearest = lambda q: np.argsort(-(q @ c.T), axis=1, kind="stable")[:, :probes]
        asked = Graphs.units(queries).withColumnRenamed("unit", "vector")
        some = asked.limit(FEW + 1).collect()
        if not some or not len(c):
            return self.spark.createDataFrame([], FOUND)
        if len(some) <= FEW:
            names, q = np.array([r.id for r in some], np.int64), np.array([r.vector for r in some], np.float64)
            own = nearest(q)

            def run(batches):
                for b in batches:
                    for k in range(b.num_rows):
                        at = np.flatnonzero((own == b.column("list")[k].as_py()).any(1))
                        for lo in range(0, len(at), tiles.TILE):
                            yield looked(b.column("list")[k].as_py(), unpacked(b.column("ids").slice(k, 1), b.column("codes").slice(k, 1)), names[at[lo : lo + tiles.TILE]], q[at[lo : lo + tiles.TILE]])

            return self.codes.where(F.col("list").isin(np.unique(own).tolist())).mapInArrow(run, FOUND)

        def probe(batches):
            for b in batches:
                own = nearest(tiles.matrix(b.column("vector"), np.float64))
                at = pa.array(np.repeat(np.arange(b.num_rows), own.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(own.ravel(), pa.int32()), b.column("id").take(at), b.column("vector").take(at)], names=["lane", "id", "vector"])

        sent = asked.mapInArrow(probe, "lane int, id long, vector array<float>")
        hold = lambda batches: (batches[0].column("lane")[0].as_py(), [r for b in batches for r in unpacked(b.column("ids"), b.column("codes"))])
        ask = lambda held, names, vectors: looked(held[0], held[1], names, tiles.matrix(vectors, np.float64))
        return tiles.meet(self.codes.withColumnRenamed("list", "lane"), sent, None, hold, ask, FOUND)

    def search(self, queries: DataFrame, k: int, probes: int = PROBES, fetched: int = FETCHED) -> DataFrame:
        """query_id, id, rank, distance, and codes, the codes that the query looked at."""
        found = self.candidates(queries, probes, fetched)
        codes = F.sum("codes").over(W.partitionBy("query_id"))
        found = found.withColumn("codes", codes).withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).where(F.col("place") <= fetched)
        q = Graphs.units(queries).select(F.col("id").alias("query_id"), F.col("unit").alias("q"))
        dot = F.aggregate(F.zip_with("unit", "q", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
        exact = found.join(self.vectors, "id").join(q, "query_id").select("query_id", "id", "codes", F.round(1 - dot, 9).alias("distance"))
        place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
        return exact.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"), "codes")

    def share(self, found: DataFrame, fetched: int = FETCHED) -> DataFrame:
        """query_id, share: bytes of the codes looked at and the vectors fetched, of all vectors' bytes."""
        c, books = self.fit()
        n, raw = self.vectors.count(), 4 * c.shape[1]
        return found.groupBy("query_id").agg(F.round((F.first("codes") * len(books) + fetched * raw) / (n * raw), 6).alias("share"))
