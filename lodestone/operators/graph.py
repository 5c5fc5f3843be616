"""Approximate nearest neighbours by navigable small-world graphs, one for each shard of the vectors.

A shard has a few thousand unit vectors. Its graph links each vector to near ones in different directions (a candidate
that is nearer to a link already chosen than to the vector itself is passed over), back from them, and to a few far
ones by chance, which make it navigable from any entry. A search keeps a beam of the best vectors seen and follows the links of the best
ones not followed yet; the beams of all shards are merged by query. Graphs are built and searched in Arrow workers, for
many queries at once in numpy. A shard's rows (place, id, unit, links) lie in one file with one row group, so a search for
few queries reads them without a shuffle; many queries, a table of any size, are dealt to the shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V

SHARD = 1 << 13
#: Near links chosen, links at most with those back, and links by chance.
NEAR, LINKS, FAR = 12, 28, 2
CANDIDATES = 40
#: Entries of a search, vectors followed at once, queries at once.
ENTRIES, FOLLOWED, AT_ONCE = 16, 4, 128
#: Queries that are sent with the task; more are dealt to the shards.
FEW = 1024
ROW = "shard int, place int, id long, unit array<float>, links array<int>"
FOUND = "query_id long, id long, distance double, seen long, of long, shard long"


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of each row among the others, nearest first, by products of blocks."""
    k, out = min(k, len(x) - 1), []
    for lo in range(0, len(x), 512):
        s = x[lo : lo + 512] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        some = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.zeros((len(s), 0), np.int64)
        out.append(np.take_along_axis(some, np.argsort(-np.take_along_axis(s, some, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, 0), np.int64)


def spread(x: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Which candidates are chosen: those that aren't nearer to one chosen before than to the row, up to `most`."""
    chosen = np.zeros(near.shape, bool)
    for lo in range(0, len(x), 256):
        c = x[near[lo : lo + 256]]
        own = np.einsum("nd,ncd->nc", x[lo : lo + 256], c)
        among = c @ c.transpose(0, 2, 1)
        take = chosen[lo : lo + 256]
        for j in range(near.shape[1]):
            hidden = (take[:, :j] & (among[:, j, :j] > own[:, j, None])).any(1)
            take[:, j] = ~hidden & (take.sum(1) < most)
    return chosen


def built(x: np.ndarray, seed: int = 11) -> np.ndarray:
    """Links of unit vectors, -1 where there are fewer."""
    n = len(x)
    links = np.full((n, LINKS), -1, np.int32)
    if n < 2:
        return links
    near = nearest(x, CANDIDATES)
    u, j = np.nonzero(spread(x, near, NEAR))
    v = near[u, j]
    far = np.random.default_rng(seed).integers(0, n, (n, FAR))
    u = np.concatenate([u, np.repeat(np.arange(n), FAR), v])
    v = np.concatenate([v, far.ravel(), u[: len(v)]])
    turn = np.concatenate([j, np.full(n * FAR, -1), CANDIDATES + j])  # far links first, then near ones, then those back, the nearest first
    keep = u != v
    u, v, turn = u[keep], v[keep], turn[keep]
    _, first = np.unique(u * n + v, return_index=True)
    order = first[np.lexsort((turn[first], u[first]))]
    u, v = u[order], v[order]
    place = np.arange(len(u)) - np.searchsorted(u, u)
    keep = place < LINKS
    links[u[keep], place[keep]] = v[keep]
    return links


class Graph:
    """A shard's graph in memory."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, links: np.ndarray):
        self.ids, self.x, self.links = ids, x, links
        self.entries = np.unique(np.linspace(0, len(ids) - 1, min(ENTRIES, len(ids))).astype(np.int64)) if len(ids) else np.zeros(0, np.int64)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """places (-1 where there are fewer), similarities and the number of vectors compared, for each of a few queries."""
        m, n = len(q), len(self.ids)
        at = np.arange(m)[:, None]
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True  # stands for no link
        best = np.full((m, beam), n, np.int64)
        score, followed = np.full((m, beam), -np.inf, np.float32), np.zeros((m, beam), bool)
        new = np.broadcast_to(self.entries, (m, len(self.entries)))
        active = np.ones(m, bool)
        while True:
            new = np.sort(np.where(new < 0, n, new), axis=1)
            new = np.where(np.concatenate([np.zeros((len(new), 1), bool), new[:, 1:] == new[:, :-1]], 1) | seen[at[: len(new)] if active.all() else np.flatnonzero(active)[:, None], new], n, new)
            rows = np.flatnonzero(active)
            seen[rows[:, None], new] = True
            s = np.einsum("md,mcd->mc", q[rows], self.x[np.minimum(new, n - 1)])
            s[new == n] = -np.inf
            every, scores, done = np.concatenate([best[rows], new], 1), np.concatenate([score[rows], s], 1), np.concatenate([followed[rows], np.zeros(new.shape, bool)], 1)
            top = np.argpartition(-scores, beam - 1, axis=1)[:, :beam]
            best[rows], score[rows], followed[rows] = (np.take_along_axis(a, top, 1) for a in (every, scores, done))
            open_ = np.where(followed | (best == n), -np.inf, score)
            nxt = np.argpartition(-open_, min(FOLLOWED, beam) - 1, axis=1)[:, :FOLLOWED]
            real = np.take_along_axis(open_, nxt, 1) > -np.inf
            active = real.any(1)
            if not active.any():
                break
            np.put_along_axis(followed, nxt, np.take_along_axis(followed, nxt, 1) | real, 1)
            nodes = np.where(real, np.take_along_axis(best, nxt, 1), n)[active]
            new = np.where((nodes < n)[:, :, None], self.links[np.minimum(nodes, n - 1)], -1).reshape(len(nodes), -1)
        return np.where(best == n, -1, best), score, seen[:, :n].sum(1)


def read_graph(batches) -> Graph:
    from .tiles import matrix

    ids = np.concatenate([b.column("id").to_numpy() for b in batches])
    x = np.concatenate([matrix(b.column("unit"), np.float32) for b in batches])
    links = np.concatenate([matrix(b.column("links"), np.int32) for b in batches])
    return Graph(ids, x, links)


def answers(graph: Graph, shard: int, names: np.ndarray, q: np.ndarray, k: int, beam: int) -> pa.RecordBatch:
    """The best k of each query in a shard, itself left out, each with how many vectors were compared of how many."""
    parts = []
    for lo in range(0, len(q), AT_ONCE):
        own = names[lo : lo + AT_ONCE]
        best, score, seen = graph.search(q[lo : lo + AT_ONCE], max(beam, k + 1))
        score = np.where((best < 0) | (graph.ids[best] == own[:, None]), -np.inf, score)
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        r, c = np.nonzero(np.take_along_axis(score, order, 1) > -np.inf)
        at = order[r, c]
        parts.append((own[r], graph.ids[best[r, at]], 1.0 - score[r, at].astype(np.float64), seen[r], np.full(len(r), len(graph.ids)), np.full(len(r), shard)))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["query_id", "id", "distance", "seen", "of", "shard"])


class Graphs:
    """A written index: folder/shards, a row a vector; folder/numbers, the number of shards."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(ROW).parquet(f"{self.folder}/shards")

    @staticmethod
    def units(vectors: DataFrame) -> DataFrame:
        """id, unit of the vectors (id, embedding) that have a direction; all of one size."""
        units = vectors.where("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), V.normalize(F.col("embedding")).alias("unit"))
        return units.where("exists(unit, x -> x <> 0) AND NOT exists(unit, x -> isnan(x))").select("id", F.col("unit").cast("array<float>").alias("unit"))

    def build(self, vectors: DataFrame, shard: int = SHARD) -> Graphs:
        units = self.units(vectors)
        n = max(1, -(-units.count() // shard))

        def run(batches: Iterator[pa.RecordBatch]):
            from .tiles import matrix

            held, now = [], None

            def grown():
                ids = np.concatenate([b.column("id").to_numpy() for b in held])
                x = np.concatenate([matrix(b.column("unit"), np.float32) for b in held])
                links = built(x)
                for lo in range(0, len(ids), 2000):
                    m = len(ids[lo : lo + 2000])
                    lists = lambda a, t: pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * a.shape[1], pa.int32()), pa.array(np.ascontiguousarray(a[lo : lo + 2000]).ravel(), t))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([pa.array([now] * m, pa.int32()), pa.array(np.arange(lo, lo + m), pa.int32()), pa.array(ids[lo : lo + 2000]), lists(x, pa.float32()), lists(links, pa.int32())], names=["shard", "place", "id", "unit", "links"])

            for batch in batches:
                own = batch.column("shard").to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero(np.diff(own)) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)]):
                    if held and own[lo] != now:
                        yield from grown()
                        held = []
                    now = int(own[lo])
                    held.append(batch.slice(lo, hi - lo))
            if held:
                yield from grown()

        dealt = units.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).repartition(n, "shard").sortWithinPartitions("shard", "id")
        dealt.mapInArrow(run, ROW).write.option("parquet.block.size", str(1 << 30)).mode("overwrite").parquet(f"{self.folder}/shards")
        self.spark.createDataFrame([(n,)], "shards int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/numbers")
        return self

    def found(self, queries: DataFrame, k: int, beam: int) -> DataFrame:
        """FOUND: the best k of each query (id, embedding) in each shard."""
        from .tiles import matrix, meet

        asked = self.units(queries).withColumnRenamed("unit", "vector")
        some = asked.limit(FEW + 1).collect()
        if len(some) > FEW:
            shards = self.spark.read.parquet(f"{self.folder}/numbers").first()[0]
            ask = lambda graph, names, vectors: answers(graph, int(graph.ids[0]), names, matrix(vectors, np.float32), k, beam)  # noqa: E731  a shard by its first id
            return meet(self.rows.withColumnRenamed("shard", "lane"), asked, shards, read_graph, ask, FOUND)
        names, q = np.array([r.id for r in some], np.int64), np.array([r.vector for r in some], np.float32)

        def run(batches):
            held, now = [], None
            for batch in batches:
                own = batch.column("shard").to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero(np.diff(own)) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)]):
                    if held and own[lo] != now:
                        yield answers(read_graph(held), int(now), names, q, k, beam)
                        held = []
                    if not held and batch.column("place")[lo].as_py() != 0:
                        raise ValueError("a shard's file was cut between tasks: its row group is larger than its option says")
                    now = own[lo]
                    held.append(batch.slice(lo, hi - lo))
            if held and len(names):
                yield answers(read_graph(held), int(now), names, q, k, beam)

        return self.rows.mapInArrow(run, FOUND) if some else self.spark.createDataFrame([], FOUND)

    def search(self, queries: DataFrame, k: int, beam: int = 80) -> DataFrame:
        """query_id, id, rank, distance."""
        from .tiles import merged

        return merged(self.found(queries, k, beam), k)

    def compared(self, queries: DataFrame, k: int, beam: int = 80) -> DataFrame:
        """query_id, share: of all vectors those that a query was compared with."""
        each = self.found(queries, k, beam).select("query_id", "shard", "seen", "of").distinct()
        return each.groupBy("query_id").agg(F.round(F.sum("seen") / F.sum("of"), 6).alias("share"))
