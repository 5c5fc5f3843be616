"""Approximate nearest neighbours by inverted lists that are written once.

k-means centroids come from a bounded sample of unit vectors; every vector is stored as a unit vector
in the list of its nearest centroid, and the list is the table's partition column, so a search reads
the lists it probes and no others. Centroids are a table of their own, broadcast (lists * dimensions
numbers). Vectors without a direction (norm 0 or null) have no list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from . import tiles

#: Vectors that the centroids are fitted on, at most.
SAMPLE = 20_000


def centroids(vectors: DataFrame, lists: int, seed: int = 7, steps: int = 12) -> np.ndarray:
    rows = vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64(F.lit(seed), "id")).limit(SAMPLE).select("embedding").collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = x[np.random.default_rng(seed).choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(steps):
        own = (x @ c.T).argmax(1)
        for k in range(len(c)):
            if (own == k).any():
                m = x[own == k].mean(0)
                c[k] = m / max(np.linalg.norm(m), 1e-12)
    return c


class Lists:
    """A written index: folder/centroids (list, c) and folder/vectors (id, unit; by list)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @property
    def centroids(self) -> DataFrame:
        return self.spark.read.schema("list int, c array<double>").parquet(f"{self.folder}/centroids")

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.schema("id long, unit array<double>, list int").parquet(f"{self.folder}/vectors")

    def build(self, vectors: DataFrame, lists: int) -> Lists:
        c = centroids(vectors, lists)
        self.spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(c)], "list int, c array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/centroids")
        nearest = self.ranked(c, 1)

        def place(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("unit"), pa.array(nearest(b.column("unit"))[:, 0], pa.int32())], names=["id", "unit", "list"])

        placed = self.units(vectors, "unit", c).mapInArrow(place, "id long, unit array<double>, list int")
        placed.repartitionByRange("list", "id").write.partitionBy("list").mode("overwrite").parquet(f"{self.folder}/vectors")
        return self

    @staticmethod
    def units(vectors: DataFrame, name: str, c: np.ndarray) -> DataFrame:
        """id and unit vector of those that have a direction and the centroids' size."""
        units = vectors.where("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), V.normalize(F.col("embedding")).alias(name))
        return units.where(F.exists(name, lambda x: x != 0) & (F.size(name) == (c.shape[1] if len(c) else -1)))

    @staticmethod
    def ranked(c: np.ndarray, n: int):
        """The n nearest lists of each vector, the nearest first, then the smaller list."""
        return lambda column: np.argsort(-(tiles.matrix(column, np.float64) @ c.T), axis=1, kind="stable")[:, :n]

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """query_id, id, rank among the vectors of the nearest lists, the query itself left out; distances count to 9 digits, ties go to the smaller id.

        Lists are cut into lanes of a bounded number of rows; a query goes to the lanes of its lists and meets their rows in matrix products,
        and only a lane's best k of it are shuffled.
        """
        stored = sorted(self.centroids.collect(), key=lambda r: r.list)  # a row a list
        if not stored:
            return self.spark.createDataFrame([], "query_id long, id long, rank int, distance double")
        c = np.array([r.c for r in stored])
        pieces = np.ones(len(c), np.int64)
        for r in self.vectors.groupBy("list").count().collect():
            pieces[r["list"]] = -(-r["count"] // tiles.LANE)
        first, nearest = np.cumsum(pieces) - pieces, self.ranked(c, probes)

        def probe(batches):
            for b in batches:
                for part in (b.slice(lo, 1024) for lo in range(0, b.num_rows, 1024)):
                    own = nearest(part.column("vector"))
                    at = np.repeat(np.arange(part.num_rows), own.shape[1])
                    n = pieces[own.ravel()]
                    lane = np.repeat(first[own.ravel()], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    to = pa.array(np.repeat(at, n))
                    yield pa.RecordBatch.from_arrays([pa.array(lane, pa.int32()), part.column("id").take(to), part.column("vector").take(to)], names=["lane", "id", "vector"])

        def hold(batches):
            return np.concatenate([b.column("id").to_numpy() for b in batches]), np.concatenate([tiles.matrix(b.column("unit"), np.float64) for b in batches])

        def ask(held, names, asked):
            ids, x = held
            best = tiles.nearest(tiles.matrix(asked, np.float64), x, names, ids, k)
            return pa.RecordBatch.from_arrays([pa.array(v) for v in best], names=["query_id", "id", "distance"])

        lane = lambda f, n: F.get(F.array(*[F.lit(int(v)) for v in f]), F.col("list")) + F.pmod(F.xxhash64("id"), F.get(F.array(*[F.lit(int(v)) for v in n]), F.col("list")))
        rows = self.vectors.select(lane(first, pieces).cast("int").alias("lane"), "id", "unit")
        sent = self.units(queries, "vector", c).mapInArrow(probe, "lane int, id long, vector array<double>")
        return tiles.merged(tiles.meet(rows, sent, None, hold, ask, "query_id long, id long, distance double"), k)
