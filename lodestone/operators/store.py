"""A managed corpus as stored versions, and small state as JSON, both in a folder that driver and executors share.

A corpus has a base and a version for each change after it; the newest version of an id counts, and a
row marked as deleted hides it. So a change writes only its own rows. Versions appear when they are whole.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Files:
    """Small files by the session's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def names(self, name: str = "") -> list[str]:
        fs, p = self._at(name) if name else self._at(".")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def exists(self, name: str) -> bool:
        fs, p = self._at(name)
        return fs.exists(p)

    def read(self, name: str, default=None):
        fs, p = self._at(name)
        if not fs.exists(p):
            return default
        stream = fs.open(p)
        try:
            return json.loads(bytearray(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def write(self, name: str, value) -> None:
        """Under another name first, then renamed, so a reader never sees a part."""
        fs, p = self._at(name)
        _, part = self._at(f"{name}.part")
        out = fs.create(part, True)
        try:
            out.write(bytearray(json.dumps(value, ensure_ascii=False).encode("utf-8")))
        finally:
            out.close()
        fs.delete(p, False)
        if not fs.rename(part, p):
            raise OSError(f"{name} can't be renamed")


class Corpus:
    """documents by version; columns as in the base, id among them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.files, self.folder = spark, Files(spark, folder), folder

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.files.names("done") if n.isdigit())

    def write(self, rows: DataFrame, deleted: bool = False) -> int:
        """Rows as the next version; deleted: only their ids count."""
        version = max(self.versions(), default=-1) + 1
        rows.withColumn("deleted", F.lit(deleted)).write.mode("overwrite").parquet(f"{self.folder}/rows/version={version}")
        self.files.write(f"done/{version}", {})
        return version

    def read(self) -> DataFrame:
        done = self.versions()
        if not done:
            raise ValueError(f"{self.folder} has no documents")
        base = self.spark.read.parquet(f"{self.folder}/rows/version={done[0]}")
        if done[1:]:
            later = self.spark.read.schema(base.schema).option("basePath", f"{self.folder}/rows").parquet(*[f"{self.folder}/rows/version={v}" for v in done[1:]])
            newest = later.withColumn("_turn", F.row_number().over(W.partitionBy("id").orderBy(F.desc("version")))).where("_turn = 1").drop("_turn", "version")
            base = base.join(newest.select("id"), "id", "left_anti").select(*base.columns).unionByName(newest.select(*base.columns))
        return base.where("NOT deleted").drop("deleted")

    def compact(self) -> None:
        """One base from all that counts now."""
        before = self.versions()
        self.write(self.read())
        for v in before:
            self.files._at(f"done/{v}")[0].delete(self.files._at(f"done/{v}")[1], False)
