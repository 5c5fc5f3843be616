"""Exact percentiles of groups of any size, by refining histograms: no task orders a group's values.

A pass counts each open group's values in SLICES equal ranges between its bounds, keeps each range's least and largest value,
and goes on within the range that holds the rank, until the bounds are one value. What meets in one place is a row a
group and range; a group's bounds are a written table with a row a group.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stored import work_folder

SLICES = 1024


def nearest_rank(df: DataFrame, by: str, value: str, place) -> DataFrame:
    """by, n, value: the value at a place of each group's ascending order, and how many values it has; place(n) counts from 1. Nulls don't count, a null group is one.

    Values are numbers; NaN is larger than all others, as Spark orders them."""
    spark, folder = df.sparkSession, work_folder(df.sparkSession, f"selection-{uuid.uuid4().hex}")
    rows = df.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).alias("v"))
    kind = rows.schema["v"].dataType.simpleString()
    if kind in ("double", "float"):  # infinite and NaN values are ends of the order of their own
        rows = rows.withColumn("x", F.when(F.col("v").isin(float("inf"), float("-inf")) | F.isnan("v"), None).otherwise(F.col("v").cast("double")))
    else:
        rows = rows.withColumn("x", F.col("v").cast("double"))

    def apart(a: Column, b: Column) -> Column:
        """How far two values are apart: halves of doubles, so that no difference is infinite; whole numbers exactly."""
        if kind in ("double", "float"):
            return a.cast("double") / 2 - b.cast("double") / 2
        exact = (lambda c: c) if kind.startswith("decimal") else (lambda c: c.cast("decimal(20,0)"))
        return (exact(a) - exact(b)).cast("double")

    def kept(state: DataFrame, k: int) -> DataFrame:
        state.write.mode("overwrite").parquet(f"{folder}/{k}")
        return spark.read.schema(state.schema).parquet(f"{folder}/{k}")

    below, above = F.coalesce(F.col("v") == float("-inf"), F.lit(False)), F.col("x").isNull() & (F.col("v") != float("-inf"))
    bounds = rows.groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull() & below).alias("low"), F.count("x").alias("finite"), F.count_if(above & ~F.isnan(F.col("v").cast("double"))).alias("high"), F.min(F.when(F.col("x").isNotNull(), F.col("v"))).alias("lo"), F.max(F.when(F.col("x").isNotNull(), F.col("v"))).alias("hi"))
    at = place(F.col("n")).cast("long")
    ends = F.when(at <= F.col("low"), F.lit(float("-inf"))).when(at <= F.col("low") + F.col("finite"), None).when(at <= F.col("low") + F.col("finite") + F.col("high"), F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    state = bounds.withColumn("end", ends.cast(kind)).select("g", "n", F.coalesce("end", "lo").alias("lo"), F.coalesce("end", "hi").alias("hi"), (at - F.col("low")).alias("at"), F.col("end").isNotNull().alias("done"))
    state, k = kept(state.withColumn("done", F.col("done") | (F.col("lo") == F.col("hi"))), 0), 0
    closed = None
    while True:
        done = state.where("done")
        closed = done if closed is None else closed.unionByName(done)
        going = state.where("NOT done")
        if going.isEmpty():
            break
        own = going.select(F.col("g").alias("of"), "n", "lo", "hi", "at")
        inside = rows.where("x IS NOT NULL").join(own, F.col("g").eqNullSafe(F.col("of"))).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        width = apart(F.col("hi"), F.col("lo"))
        part = F.when(width > 0, F.least(F.lit(SLICES - 1), F.floor(F.try_divide(apart(F.col("v"), F.col("lo")), width) * SLICES)).cast("int")).otherwise((F.col("v") > F.col("lo")).cast("int"))
        counted = inside.groupBy("of", "n", "at", part.alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = counted.withColumn("upto", F.sum("c").over(W.partitionBy("of").orderBy("part").rowsBetween(W.unboundedPreceding, 0)))  # SLICES rows of a group
        hit = upto.where((F.col("upto") >= F.col("at")) & (F.col("upto") - F.col("c") < F.col("at")))
        k += 1
        state = kept(hit.select(F.col("of").alias("g"), "n", "lo", "hi", (F.col("at") - F.col("upto") + F.col("c")).alias("at"), (F.col("lo") == F.col("hi")).alias("done")), k)
    return closed.select(F.col("g").alias(by), "n", F.col("lo").alias(value))
