"""The change log as a stream that maintains a stored index: each micro-batch is a chunk of so many tasks, and one version.

The stream's source is a Python data source whose offsets are row_ids of the log: it gives where a chunk begins and
ends, and Spark reads the chunk's tasks. What is applied is told by the index's markers, so a batch that
runs again after its commit counts once, and neither a lost checkpoint nor a compaction in between changes anything.
Progress is told as events; a run can be cancelled between chunks. Tasks that are logged later have larger row_ids.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.stored import Index

CHUNK_DEFAULT, CHUNK_MOST = 100, 1000
#: Ends of chunks that a run of the stream is told at once.
ENDS = 100_000
BEFORE_ALL = -(1 << 63)


def chunk_size(value=None) -> int:
    """Tasks or rows a chunk has: 1 to 1000, 100 where none is given."""
    if value is None:
        return CHUNK_DEFAULT
    return max(1, min(CHUNK_MOST, math.trunc(value)))


class Chunks(DataSourceStreamReader):
    """A micro-batch is a chunk: one row with the row_id before its first task and that of its last."""

    def __init__(self, begin: int, ends: list[int]):
        self.begin, self.at, self.ends = begin, begin, ends

    def initialOffset(self) -> dict:
        return {"row_id": self.begin}

    def latestOffset(self) -> dict:
        return {"row_id": next((e for e in self.ends if e > self.at), self.at)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["row_id"])
        return [InputPartition((start["row_id"], end["row_id"]))]

    def read(self, partition: InputPartition):
        yield partition.value

    def commit(self, end: dict) -> None:
        self.at = max(self.at, end["row_id"])


class ChangeLog(DataSource):
    """Options: begin, the row_id before the first task; ends, those of the chunks' last ones."""

    @classmethod
    def name(cls) -> str:
        return "change_log_chunks"

    def schema(self) -> str:
        return "after long, upto long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Chunks(int(self.options["begin"]), json.loads(self.options["ends"]))


def chunk_ends(rows: DataFrame, chunk: int) -> list[int]:
    """The row_ids of every chunk-th row and of the last one, ENDS of them at most. Rows are numbered by ranges, each by itself."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("row_id").repartitionByRange(n, "row_id").withColumn("part", F.spark_partition_id()).persist()
    try:
        counts = {r.part: r["count"] for r in dealt.groupBy("part").count().collect()}  # a row a range
        before, total = [], 0
        for part, c in sorted(counts.items()):
            before.append((part, total))
            total += c
        if not total:
            return []
        offsets = rows.sparkSession.createDataFrame(before, "part int, before long")
        place = F.row_number().over(W.partitionBy("part").orderBy("row_id")) + F.col("before")
        ends = dealt.join(F.broadcast(offsets), "part").select("row_id", place.alias("place")).where((F.col("place") % chunk == 0) | (F.col("place") == total))
        return sorted({r.row_id for r in ends.orderBy("row_id").limit(ENDS).collect()})
    finally:
        dealt.unpersist()


def maintain(spark: SparkSession, log_folder: str, folder: str, checkpoint: str, chunk: int = CHUNK_DEFAULT, emit: Callable[[dict], None] | None = None, cancelled: Callable[[], bool] | None = None):
    """Applies the log's waiting tasks in chunks, by row_id, and stops; the index must have a base. Gives the last event: completed, cancelled or error."""
    emit, cancelled = emit or (lambda event: None), cancelled or (lambda: False)
    index = Index(spark, folder)
    log = spark.read.parquet(log_folder)
    seen = {"batches": 0, "tasks": 0}

    class Cancelled(Exception):
        pass

    def step(batch: DataFrame, k: int) -> None:
        if cancelled():
            raise Cancelled
        for r in batch.collect():  # one row
            done = index.applied()
            after = r.after if done is None else max(r.after, done)
            tasks = log.where((F.col("row_id") > after) & (F.col("row_id") <= r.upto))
            n = tasks.count()
            if n:
                index.apply(tasks, f"to-{r.upto}")
                seen["batches"], seen["tasks"] = seen["batches"] + 1, seen["tasks"] + n
                emit({"event": "chunk", "batch": seen["batches"] - 1, "processed": n, "total": seen["tasks"]})

    emit({"event": "started", "chunkSize": chunk})
    spark.dataSource.register(ChangeLog)
    try:
        while True:
            done = index.applied()
            waiting = log if done is None else log.where(F.col("row_id") > done)
            ends = chunk_ends(waiting, chunk)
            if not ends:
                break
            stream = spark.readStream.format("change_log_chunks").option("begin", str(BEFORE_ALL if done is None else done)).option("ends", json.dumps(ends)).load()
            query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
            try:
                query.processAllAvailable()
            finally:
                query.stop()
        last = {"event": "completed", **seen}
    except Exception as e:  # the chunk has no marker: the next run begins with it
        if not cancelled():
            last = {"event": "error", "message": str(e).splitlines()[0], **seen}
            emit(last)
            raise
        last = {"event": "cancelled", **seen}
    emit(last)
    return last
