"""Many stored queries against all vectors: tiles of queries times tiles of rows as matrix products in Arrow workers.

Rows are dealt to lanes of a bounded number of rows; each query goes to every lane, and each lane gives its best k of it, merged by
query. Nothing is broadcast, and a task holds one lane's rows and one tile of queries.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a lane, about.
LANE = 1 << 15
#: Queries and rows of a product.
TILE, BLOCK = 256, 1 << 12


def matrix(column: pa.ListArray, dtype) -> np.ndarray:
    """Vectors of one size, as rows."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def meet(rows: DataFrame, queries: DataFrame, lanes: int | None, hold: Callable, ask: Callable, schema: str) -> DataFrame:
    """rows: lane and columns; queries: id, vector, each asked in all of so many lanes, or with the lane where it is asked. hold(batches of a lane's rows) -> what a lane is; ask(it, ids, vectors of a tile) -> batch or None."""
    where = F.col("lane") if lanes is None else F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    sent = queries.select(where, F.lit(1).alias("asks"), F.col("id").alias("query_id"), F.col("vector").alias("asked"))
    own = rows.select("lane", F.lit(0).alias("asks"), *[c for c in rows.columns if c != "lane"])
    both = own.unionByName(sent, allowMissingColumns=True)
    order = [c for c in ("lane", "asks", "place", "id") if c in both.columns]
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches):
        now, held, kept = None, None, []
        for batch in batches:
            lane, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lane", "asks"))
            cuts = np.flatnonzero((np.diff(lane) != 0) | (np.diff(asks) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lane)]):
                if lo == hi:
                    continue
                if lane[lo] != now:
                    now, held, kept = lane[lo], None, []
                part = batch.slice(lo, hi - lo)
                if not asks[lo]:
                    kept.append(part)
                    continue
                if held is None and kept:
                    held, kept = hold(kept), []
                for at in range(0, part.num_rows if held is not None else 0, TILE):
                    tile = part.slice(at, TILE)
                    if (found := ask(held, tile.column("query_id").to_numpy(), tile.column("asked"))) is not None:
                        yield found

    return both.repartition(n, "lane").sortWithinPartitions(*order).mapInArrow(run, schema)


def smallest(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k least of each row, then least ids; inf doesn't count."""
    kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
    r, c = np.nonzero((d <= kth[:, None]) & (d < np.inf))
    order = np.lexsort((ids[c], d[r, c], r))
    r, c = r[order], c[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep]


def nearest(q: np.ndarray, x: np.ndarray, names: np.ndarray, ids: np.ndarray, k: int, digits: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance): of each query the k nearest of a lane's rows, the query itself left out. A block of rows is looked at
    only where it has a distance below the query's k-th so far or equal to it."""
    found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    far = np.full(len(q), np.inf)
    for lo in range(0, len(ids), BLOCK):
        own = ids[lo : lo + BLOCK]
        d = q @ x[lo : lo + BLOCK].T
        np.round(np.subtract(1, d, out=d), digits, out=d)
        own_row = np.argsort(own, kind="stable")
        at = np.searchsorted(own, names, sorter=own_row)
        there = np.flatnonzero(at < len(own))
        there = there[own[own_row[at[there]]] == names[there]]
        for r in there.tolist():
            d[r, own == names[r]] = np.inf
        r, c = smallest(d, own, k) if lo == 0 else np.nonzero((d <= far[:, None]) & (d < np.inf))
        row, i, dist = (np.concatenate(v) for v in zip(found, (r, own[c], d[r, c])))
        order = np.lexsort((i, dist, row))
        row, i, dist = row[order], i[order], dist[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        found = [row[keep], i[keep], dist[keep]]
        last = np.searchsorted(found[0], np.arange(len(q)), "right")
        full = last - np.searchsorted(found[0], np.arange(len(q))) == k
        far[full] = found[2][last[full] - 1]
    return names[found[0]], found[1], found[2]


def merged(found: DataFrame, k: int) -> DataFrame:
    """query_id, id, rank, distance: the best k of what the lanes found."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


def lanes_of(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // LANE))


def neighbors(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """query_id, id, rank, distance: the k nearest by cosine of each query (id, embedding), itself left out. Vectors of other sizes than the query's, without a
    direction or with numbers that aren't finite have no distance."""
    def usable(df, name):
        e = F.transform("embedding", lambda x: x.cast("double"))
        norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x))
        return df.where("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), e.alias(name)).where((norm > 0) & (norm < float("inf")))

    rows = usable(vectors, "vector")
    lanes = lanes_of(rows)
    rows = rows.withColumn("lane", F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int"))

    def unit(x):
        return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]

    def by_size(column):
        sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            yield int(size), at, unit(matrix(column.take(pa.array(at)), np.float64))

    def hold(batches):
        ids, out = np.concatenate([b.column("id").to_numpy() for b in batches]), {}
        every = pa.concat_arrays([b.column("vector") for b in batches])
        for size, at, x in by_size(every):
            out[size] = ids[at], x
        return out

    def ask(held, names, asked):
        parts = []
        for size, at, q in by_size(asked):
            if size in held:
                ids, x = held[size]
                parts.append(nearest(q, x, names[at], ids, k, digits))
        if not parts:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["query_id", "id", "distance"])

    return merged(meet(rows, usable(queries, "vector"), lanes, hold, ask, "query_id long, id long, distance double"), k)
