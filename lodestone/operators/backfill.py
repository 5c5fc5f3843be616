"""Backfill of derived columns: what is missing, chunks by key, and their processing as one distributed pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V


def needs(df: DataFrame, snapshot: bool = False):
    missing = F.col("embedding_hnsw").isNull() | F.col("fts").isNull() | F.col("textlen").isNull()
    return F.col("id").isNotNull() if snapshot else F.col("id").isNotNull() & missing


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_if(needs(df)).alias("needs_backfill"), F.count_if(needs(df, snapshot=True)).alias("snapshot_rows"))


def chunk(df: DataFrame, last: int | None, size: int, snapshot: bool = False) -> DataFrame:
    """The next rows by id: a filter and a top-k, never a sort of the table."""
    rows = df.where(needs(df, snapshot))
    return (rows if last is None else rows.where(F.col("id") > last)).orderBy("id").limit(size)


def process(df: DataFrame, dim: int, hnsw_dim: int) -> DataFrame:
    """Missing columns filled and whether the row goes to the index queue. df: id, content, fts, textlen, embedding, legacy, embedding_hnsw."""
    tokens = F.coalesce("fts", T.tokens(F.col("content")))
    filled = df.withColumn("queued", F.col("fts").isNull() | F.col("textlen").isNull()).withColumn("fts", tokens)
    return filled.withColumn("textlen", F.coalesce("textlen", T.text_length(F.col("fts")))).withColumn("embedding_hnsw", F.coalesce("embedding_hnsw", V.backfill_hnsw(F.col("embedding"), F.col("legacy"), dim, hnsw_dim)))


def with_legacy(df: DataFrame, legacy: DataFrame | None) -> DataFrame:
    """The rows with the vector of an older table that has their hash (column legacy); null where there is no such table. legacy: doc_hash, embedding, a row a hash."""
    if legacy is None:
        return df.withColumn("legacy", F.lit(None).cast("array<double>"))
    return df.join(legacy.select("doc_hash", F.col("embedding").alias("legacy")), "doc_hash", "left")


def status(state: DataFrame) -> DataFrame:
    return state.select("table_name", "status", "total_rows", "processed_rows", F.greatest(F.col("total_rows") - F.col("processed_rows"), F.lit(0)).alias("remaining_rows"))


def run(df: DataFrame, size: int) -> DataFrame:
    """The progress that chunks of that size make, from the rows' places by key: chunk number, last id, rows processed, state after it.

    Places come from ranges of ids: ids are dealt to ranges, counted, and only places that end a chunk are kept.
    """
    rows = df.where(needs(df)).select("id")
    parts = rows.withColumn("part", F.floor(F.col("id") / 4096))
    ranges = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.col("part") / 4096))  # sums within runs of ranges, then over the runs: a row for each 16 million ids
    sums = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = ranges.groupBy("run").agg(F.sum("n").alias("n")).select("run", sums(W.orderBy("run")).alias("first"))
    before = ranges.withColumn("within", sums(W.partitionBy("run").orderBy("part"))).join(runs, "run").select("part", (F.col("first") + F.col("within")).alias("before"))
    placed = parts.join(before, "part").withColumn("place", F.col("before") + F.row_number().over(W.partitionBy("part").orderBy("id")))
    total = ranges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    ends = placed.crossJoin(F.broadcast(total)).where((F.col("place") % size == 0) | (F.col("place") == F.col("total")))
    return ends.select(F.ceil(F.col("place") / size).cast("long").alias("chunk"), F.col("id").alias("last_id"), F.col("place").cast("long").alias("processed"), F.when(F.col("place") == F.col("total"), "completed").otherwise("running").alias("state"))


#: Ranges of ids of a back-fill, and how many are processed in one job.
RANGES, TOGETHER = 64, 16


class Run:
    """A back-fill over a stored table by ranges of ids, each whole once its marker is there; a run that was stopped goes on with the others.

    Boundaries are quantiles of the ids, found once and kept with the run. A job processes the ranges of a stretch of ids in
    parallel and reads only those (the filter reaches the scan), so the table is read once in all.
    """

    def __init__(self, spark, folder: str, ranges: int = RANGES):
        from .store import Files

        self.spark, self.folder, self.ranges, self.files = spark, folder, ranges, Files(spark, folder)

    def bounds(self, df: DataFrame) -> list[int]:
        """The first ids of all ranges but the first."""
        found = self.files.read("bounds.json")
        if found is None:
            shares = [k / self.ranges for k in range(1, self.ranges)]
            found = sorted(set(df.where("id IS NOT NULL").approxQuantile("id", shares, 1 / (4 * self.ranges)))) if shares else []
            found = [int(b) for b in found]
            self.files.write("bounds.json", found)
        return found

    def left(self, df: DataFrame) -> list[int]:
        """The ranges without a marker."""
        done = {int(n) for n in self.files.names("done") if n.isdigit()}
        return [k for k in range(len(self.bounds(df)) + 1) if k not in done]

    def go(self, df: DataFrame, make, emit=None, cancelled=None) -> DataFrame:
        """make(rows) -> rows after it, for all rows with an id; gives the written result so far. emit gets the ranges done; cancelled() is asked between jobs."""
        bounds, left = self.bounds(df), self.left(df)
        place = F.lit(0)
        for b in bounds:
            place = place + (F.col("id") >= b).cast("int")
        while left and not (cancelled and cancelled()):
            some = [k for k in left if k < left[0] + TOGETHER]
            low, high = ([None, *bounds][some[0]]), ([*bounds, None][some[-1]])
            rows = df.where("id IS NOT NULL")
            rows = rows if low is None else rows.where(F.col("id") >= low)
            rows = rows if high is None else rows.where(F.col("id") < high)
            if len(some) < some[-1] - some[0] + 1:
                rows = rows.where(place.isin(some))
            own = make(rows).withColumn("range", place)
            for k in some:  # what a stopped job left of them
                fs, p = self.files._at(f"rows/range={k}")
                fs.delete(p, True)
            own.write.partitionBy("range").mode("append").parquet(f"{self.folder}/rows")
            for k in some:
                self.files.write(f"done/{k}", {})
            left = left[len(some) :]
            if emit:
                emit({"event": "chunk", "ranges": some, "remaining": len(left)})
        return self.result(make(df).schema)

    def result(self, schema) -> DataFrame:
        """The rows of the ranges that are whole."""
        done = [k for k in self.files.names("done") if k.isdigit()]
        paths = [f"{self.folder}/rows/range={k}" for k in done if self.files.exists(f"rows/range={k}")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
