"""What the operators of this subpackage share: the folder all executors see, and Arrow batches cut to a bounded size."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker lays out at once; a longer text makes a batch of its own.
BATCH_BYTES = 1 << 21


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors see; only a local master does without that setting, with a folder of this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        global _own
        _own = _own or "file://" + tempfile.mkdtemp(prefix="lodestone-")
        top = _own
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_own: str | None = None
#: Shuffle files go when the query that made them ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows as a written table: lineage ends here, a lost executor costs no recomputation, and the shuffle files on the way are deleted."""
    spark = df.sparkSession
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of a table, as its columns lie in memory, that may be broadcast.
MOST_BYTES = 8 << 20


def small(table: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if it has few bytes (a pass over it adds them up); else as it is, so that joins shuffle."""
    wide = {"long": 8, "bigint": 8, "double": 8, "timestamp": 8, "int": 4, "float": 4, "boolean": 1}
    size = F.lit(32)  # of a row besides its values
    for name, kind in table.dtypes:
        if kind in ("string", "binary"):
            size = size + 8 + F.coalesce(F.octet_length(F.col(name)), F.lit(0))
        elif kind.startswith("array"):
            size = size + 32 + 32 * F.greatest(F.lit(0), F.coalesce(F.size(F.col(name)), F.lit(0)))
        else:
            size = size + wide.get(kind, 16)
    return F.broadcast(table) if (table.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most else table


_kept: dict = {}


def kept(key, make):
    """What a worker process holds from task to task, made once: the last such thing only, so that workers that live on after a stage don't hold what no task uses."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Lets go of it, in tasks that need memory and hold nothing."""
    _kept.clear()


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator reads, so that others (of any name) neither cost a read nor clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c) for c in more])


def cut(batches, most_bytes: int = BATCH_BYTES, column: str = "text"):
    """Record batches again, each with about that many bytes in the column at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        lo, size = 0, 0
        for i, n in enumerate(sizes):
            if i > lo and size + n > most_bytes:
                yield batch.slice(lo, i - lo)
                lo, size = i, 0
            size += n
        yield batch.slice(lo)


def map_texts(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn(columns of a cut batch, as lists by name) -> columns of the result, by name, for each batch of at most BATCH_BYTES of text."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in cut(batches):
            made = fn({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)
