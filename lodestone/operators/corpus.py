"""The corpus: canonical columns, content hash, and changes of documents as functions from table to table.

Parquet tables can't be merged in place; each change gives the new table, to be written beside the old one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

ROLES = {"id": "long", "doc_hash": "string", "title": "string", "content": "string", "contributors": "string", "namespace": "string", "language": "string", "textlen": "int"}


def title_of(content: Column) -> Column:
    return F.left(F.substring_index(content, "\n", 1), F.lit(80))  # stops at the first line's end


def content_hash(title: Column, content: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), content).cast("binary"), 256)


def with_roles(df: DataFrame, roles: dict[str, Column]) -> DataFrame:
    """The canonical columns of a table; a role without a column is null."""
    return df.select(*[roles.get(r, F.lit(None)).cast(t).alias(r) for r, t in ROLES.items()])


def documents(df: DataFrame) -> DataFrame:
    c = F.col("text")
    return with_roles(df, {"id": F.col("doc_id"), "doc_hash": content_hash(title_of(c), c), "title": title_of(c), "content": c, "namespace": F.col("source"), "language": F.col("lang"), "textlen": T.text_length(T.tokens(c))})


def last_write(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_turn", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_turn = 1").drop("_turn")


def upsert(target: DataFrame, source: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Rows of source replace those of target with the same key; the columns in keep stay the target's. One row a key in source."""
    s = source.select(*[F.col(c).alias(f"_{c}") for c in source.columns])
    merged = target.join(s, F.col(key) == F.col(f"_{key}"), "full_outer")
    new = F.col(f"_{key}").isNotNull()
    pick = lambda c: F.coalesce(F.col(c), F.col(f"_{c}")) if c in keep or c == key else F.when(new, F.col(f"_{c}")).otherwise(F.col(c))
    return merged.select(*[pick(c).alias(c) for c in target.columns])


def insert_ignore(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    return target.unionByName(source.join(target, key, "left_anti").dropDuplicates([key]))


def sequence_seat(*ids: DataFrame) -> DataFrame:
    """The largest id of all tables, 1 at least. ids: one-column tables."""
    every = ids[0]
    for i in ids[1:]:
        every = every.union(i)
    return every.agg(F.greatest(F.coalesce(F.max(every.columns[0]), F.lit(0)), F.lit(1)).cast("long").alias("seat"))


def insert(target: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """New rows get the ids after the target's largest, in order. The new rows of a request are few; they are numbered in one task."""
    seat = target.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_seat"))
    numbered = new.withColumn("_n", F.row_number().over(W.orderBy(order))).crossJoin(F.broadcast(seat)).withColumn("id", F.col("_seat") + F.col("_n"))
    return target.unionByName(numbered.select(*target.columns))


def update(target: DataFrame, patch: DataFrame) -> DataFrame:
    """patch: id and, for each changed column c, has_c (whether it is given) and c; a given null clears."""
    changed = [c for c in patch.columns if f"has_{c}" in patch.columns]
    p = patch.select(F.col("id").alias("_id"), *[F.col(f"has_{c}") for c in changed], *[F.col(c).alias(f"_{c}") for c in changed])
    joined = target.join(p, F.col("id") == F.col("_id"), "left")
    new = lambda c: F.when(F.coalesce(F.col(f"has_{c}"), F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)) if c in changed else F.col(c)
    out = joined.select(*[new(c).alias(c) for c in target.columns])
    return out.withColumn("textlen", T.text_length(T.tokens(F.col("content")))) if "content" in changed and "textlen" in target.columns else out


def delete(target: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return target.join(ids, key, "left_anti")


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in df.columns])


def unique_suffix(name: str, taken) -> str:
    """A table suffix of letters, digits and underscores that isn't taken."""
    import hashlib
    import re

    slug = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") or "lang"
    tries = [slug, f"{slug}_{hashlib.sha1(name.encode()).hexdigest()[:6]}"]
    n = 2
    while tries[-1] in taken and tries[0] in taken:
        tries.append(f"{tries[1]}_{n}")
        n += 1
    return next(t for t in tries if t not in taken)
