"""Ingest: projected Parquet scans and row targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("title", "text", "contributors", "namespace")


def scan(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """The four columns as strings; missing ones are null, rows without text go; max_rows 0 gives none."""
    df = spark.read.parquet(path)
    out = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in COLUMNS]).where("text IS NOT NULL AND text <> ''")
    return out if max_rows is None else out.limit(max_rows)

