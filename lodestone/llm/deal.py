"""Dealing rows to tasks evenly: running sums over ranges, and joins in which a key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import written

#: A key is hot if it has more than 1 / (HOT * partitions) of the rows, so there are HOT * partitions hot keys at most.
HOT = 8


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Tasks of a job that reads pieces of files, at most; beyond, a task reads several that lie together.
MOST_TASKS = 1 << 12


def dealt(pieces: DataFrame, *order: str) -> DataFrame:
    """A written table of pieces of about one size, in as many partitions as there are pieces, MOST_TASKS at most: each has a run of them in that order, about as many as the others."""
    n = min(MOST_TASKS, max(1, pieces.count()))
    return pieces.repartitionByRange(n, *order)


def running(table: DataFrame, order: list[str], sums: list[str], path: str) -> DataFrame:
    """table with upto_x for each column x of sums: its sum over all rows up to this one. No two rows are equal in the order.

    Rows are dealt by ranges and written with their range; each range is summed by itself, and what lies before it
    comes from a row a range. Only those rows, as many as shuffle partitions, meet in one task.
    """
    dealt = written(table.repartitionByRange(partitions(table), *order).withColumn("part", F.spark_partition_id()), path)
    return summed(dealt, "part", order, sums)


def summed(table: DataFrame, part: str, order: list[str], sums: list[str]) -> DataFrame:
    """The same for a table whose column part numbers ranges of the order, a bounded number of them."""
    upto = [F.sum(c).over(W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)).alias(f"upto_{c}") for c in sums]
    before = table.groupBy(part).agg(*[F.sum(c).alias(f"all_{c}") for c in sums])
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # a row a range
    before = before.select(part, *[F.coalesce(F.sum(f"all_{c}").over(earlier), F.lit(0)).alias(f"before_{c}") for c in sums])
    both = table.select("*", *upto).join(F.broadcast(before), part)
    return both.select(*table.columns, *[(F.col(f"upto_{c}") + F.col(f"before_{c}")).alias(f"upto_{c}") for c in sums])


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with the columns of table, a row a key, for the keys that it has. Both are written tables.

    The few keys that very many rows have are broadcast, by their definition HOT * partitions rows at most; the others are
    shuffled, and none of those has more rows than 1 / (HOT * partitions) of all.
    """
    most = rows.count() / (HOT * partitions(rows))
    hot = rows.groupBy(key).agg(F.count("*").alias("hot_rows")).where(F.col("hot_rows") > most).select(key)
    crowded = table.join(F.broadcast(hot), key, "left_semi")
    few = rows.join(F.broadcast(hot), key, "left_anti").join(table.hint("merge"), key)
    return rows.join(F.broadcast(crowded), key).unionByName(few)
