"""A stored table in files of disjoint key ranges, whose changes rewrite only the files they touch.

A version is a table of its files: path, least and largest key, rows, and a Bloom filter of the keys. A change finds the file
whose range has each of its keys (the ends of the ranges, a row a file, are all that is sent to tasks); updates and deletes ask the
filters, then the keys themselves by `_metadata.file_path`, and leave files without a hit alone. Each touched file becomes one or more new
ones in its range, and the new version appears when its pointer is renamed; a change that fails leaves only files that no version names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Files

#: Bits of a file's filter for each of its keys, bits set for a key.
BITS, SET = 10, 5
#: Rows of a file, at most about.
ROWS = 1 << 20
ENTRY = "path string, lo long, hi long, rows long, bits binary"


def places(h: np.ndarray, size: int) -> np.ndarray:
    """SET bits of each 64-bit hash in a filter of that many bits."""
    a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return ((a[:, None] + np.arange(SET, dtype=np.uint64) * b[:, None]) % np.uint64(size)).astype(np.int64)


class Keyed:
    """A table with a unique long key in a folder."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "id"):
        self.spark, self.folder, self.key, self.files = spark, folder, key, Files(spark, folder)

    def version(self) -> int:
        return max((int(n) for n in self.files.names("done") if n.isdigit()), default=-1)

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(f"{self.folder}/manifests/{self.version()}")

    def entries(self) -> list:
        """path, lo, hi of the files, by range: a row a file."""
        return sorted(self.manifest().select("path", "lo", "hi").collect(), key=lambda r: r.lo)

    def read(self, paths: list[str] | None = None) -> DataFrame:
        paths = [r.path for r in self.entries()] if paths is None else paths
        schema = self.spark.read.parquet(f"{self.folder}/schema").schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _described(self, paths: list[str]) -> DataFrame:
        """ENTRY of written files."""
        key = self.key
        rows = self.spark.read.parquet(*paths).select(F.col("_metadata.file_path").alias("path"), F.col(key).cast("long").alias("k"))
        sizes = rows.groupBy("path").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("rows"))
        size = {r.path: r.rows for r in sizes.collect()}  # a row a file

        def filters(batches):
            own: dict[str, np.ndarray] = {}
            for b in batches:
                path, h = np.array(b.column("path").to_pylist(), object), b.column("h").to_numpy().view(np.uint64)
                for p in np.unique(path):
                    n = -(-size[p] * BITS // 8) * 8
                    bits = own.setdefault(p, np.zeros(n, bool))
                    bits[places(h[path == p], n).ravel()] = True
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(list(own)), pa.array([np.packbits(x).tobytes() for x in own.values()])], names=["path", "bits"])

        one = rows.withColumn("h", F.xxhash64("k")).drop("k").repartition("path").mapInArrow(filters, "path string, bits binary")  # all of a file's keys in one task
        return sizes.join(one, "path").select("path", "lo", "hi", "rows", "bits")

    def _commit(self, kept: DataFrame | None, new: list[str]) -> int:
        version = self.version() + 1
        out = self._described(new) if new else None
        out = kept if out is None else out if kept is None else kept.unionByName(out)
        (out if out is not None else self.spark.createDataFrame([], ENTRY)).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifests/{version}")
        self.files.write(f"done/{version}", {})
        return version

    def _written(self, rows: DataFrame) -> list[str]:
        """Writes rows that are dealt already; the paths of the files."""
        path = f"{self.folder}/rows/{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", ROWS).parquet(path)
        return [r.p for r in self.spark.read.schema(rows.schema).parquet(path).select(F.col("_metadata.file_path").alias("p")).distinct().collect()]

    def create(self, rows: DataFrame, files: int | None = None) -> int:
        """All rows, dealt to files by key."""
        rows.limit(0).write.mode("overwrite").parquet(f"{self.folder}/schema")
        n = files or max(1, -(-rows.count() // ROWS))
        return self._commit(None, self._written(rows.repartitionByRange(n, self.key).sortWithinPartitions(self.key)))

    def owned(self, rows: DataFrame, entries: list, to: str = "owner") -> DataFrame:
        """rows with the number of the file whose range has the key, or else is the last before it."""
        starts = np.array([r.lo for r in entries], np.int64)

        def number(batches):
            for b in batches:
                at = np.searchsorted(starts, b.column(key).to_numpy(zero_copy_only=False).astype(np.int64), "right") - 1
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.maximum(at, 0), pa.int32())], names=[*b.schema.names, to])

        key = self.key
        from pyspark.sql.types import IntegerType, StructField, StructType

        return rows.mapInArrow(number, StructType([*rows.schema.fields, StructField(to, IntegerType())]))

    def holding(self, keys: DataFrame) -> list[str]:
        """The files that hold some of the keys: by range, by filter, then by the keys in them."""
        entries = self.entries()
        if not entries:
            return []
        own = self.owned(keys.select(F.col(self.key).cast("long").alias(self.key)).distinct(), entries)
        paths = self.spark.createDataFrame([(k, r.path) for k, r in enumerate(entries)], "owner int, path string")
        bits = self.manifest().join(paths, "path").select("owner", "bits")
        may = own.join(bits, "owner").withColumn("h", F.xxhash64(self.key))

        def asked(batches):
            for b in batches:
                h, rows = b.column("h").to_numpy().view(np.uint64), b.column("bits").to_pylist()
                hit = []
                for k, raw in enumerate(rows):
                    size = 8 * len(raw)
                    at = places(h[k : k + 1], size)[0]
                    hit.append(all(raw[i >> 3] >> (7 - (i & 7)) & 1 for i in at.tolist()))
                some = b.filter(pa.array(hit))
                yield pa.RecordBatch.from_arrays([some.column("owner"), some.column(self_key)], names=["owner", "k"])

        self_key = self.key
        may = may.mapInArrow(asked, "owner int, k long").persist()
        try:
            some = [entries[r.owner].path for r in may.select("owner").distinct().collect()]
            if not some:
                return []
            rows = self.spark.read.parquet(*some).select(F.col(self.key).cast("long").alias("k"), F.col("_metadata.file_path").alias("p"))
            return [r.p for r in rows.join(may.select("k"), "k", "left_semi").select("p").distinct().collect()]
        finally:
            may.unpersist()

    def _rewritten(self, touched: list[str], made: DataFrame) -> int:
        """made: what the touched files hold after the change, each row to the range it belongs to."""
        entries = self.entries()
        if entries:
            made = self.owned(made, entries)
            new = self._written(made.repartition(max(1, len(touched)), "owner").sortWithinPartitions("owner", self.key).drop("owner")) if len(touched) <= 1 else self._by_owner(made, len(touched))
        else:
            new = self._written(made.repartitionByRange(1, self.key).sortWithinPartitions(self.key))
        return self._commit(self.manifest().where(~F.col("path").isin(touched)) if touched else self.manifest(), new)

    def _by_owner(self, made: DataFrame, n: int) -> list[str]:
        path = f"{self.folder}/rows/{uuid.uuid4().hex}"
        made.repartition(n, "owner").sortWithinPartitions("owner", self.key).write.partitionBy("owner").option("maxRecordsPerFile", ROWS).parquet(path)
        return [r.p for r in self.spark.read.schema(made.schema).parquet(path).select(F.col("_metadata.file_path").alias("p")).distinct().collect()]

    def upsert(self, source: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """merge(rows of the touched files, source) -> their rows after it. A source key is new or in the file of its range."""
        entries = self.entries()
        owners = [r.owner for r in self.owned(source.select(F.col(self.key).cast("long").alias(self.key)), entries).select("owner").distinct().collect()] if entries else []
        touched = [entries[k].path for k in owners]
        return self._rewritten(touched, merge(self.read(touched), source))

    def change(self, keys: DataFrame, make: Callable[[DataFrame], DataFrame]) -> int:
        """An update or delete of rows with these keys: make(rows of the touched files) -> their rows after it."""
        touched = self.holding(keys)
        return self._rewritten(touched, make(self.read(touched))) if touched else self.version()
