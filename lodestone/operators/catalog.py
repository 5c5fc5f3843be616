"""The catalog: languages, settings, managed tables and their readiness. These tables have a row per managed table, so joins broadcast them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGE_PRIORITY = ["korean", "english", "japanese", "chinese"]


def resolve_context(tables: DataFrame, languages: DataFrame, settings: DataFrame, status: DataFrame, name: str | None = None) -> DataFrame:
    """The active, eligible table of that name, or else the default one; without a default the first by name."""
    t = tables.join(F.broadcast(languages), "language", "left").join(F.broadcast(settings), "language", "left").join(F.broadcast(status), "table_name", "left")
    t = t.where(F.col("is_active") & F.coalesce("search_eligible", F.lit(False)))
    if name is not None:
        t = t.where(F.col("table_name") == name)
    return t.orderBy(F.desc("is_default"), "table_name").limit(1).select("table_name", "language", "table_suffix", "k1", "b", "is_default")


def tables_summary(tables: DataFrame, languages: DataFrame, settings: DataFrame, status: DataFrame) -> DataFrame:
    t = tables.join(F.broadcast(languages), "language", "left").join(F.broadcast(settings), "language", "left").join(F.broadcast(status), "table_name", "left")
    return t.select("table_name", "language", "table_suffix", "k1", "b", "is_default", "is_active", F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("embedding_coverage", F.lit(0.0)).alias("embedding_coverage"), F.coalesce("search_eligible", F.lit(False)).alias("search_eligible"))


def language_summary(languages: DataFrame, settings: DataFrame, tables: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per language its settings, active tables, documents and the plain mean of the tables' mean lengths."""
    active = tables.where("is_active").select("table_name", F.col("language").alias("of"))
    t = languages.join(F.broadcast(settings), "language").join(F.broadcast(active), F.col("language") == F.col("of"), "left").join(F.broadcast(lengths), "table_name", "left")
    return t.groupBy("language", "table_suffix", "k1", "b").agg(F.count("table_name").alias("tables"), F.coalesce(F.sum("recordcount"), F.lit(0)).alias("documents"), F.coalesce(F.sum("sumlen"), F.lit(0)).alias("sumlen"), F.round(F.coalesce(F.avg("avglen"), F.lit(0.0)), 6).alias("avglen"))


def coverage(rows: DataFrame) -> DataFrame:
    """rows: table_name, has_embedding, has_fts. Coverage is 1 for an empty table."""
    g = rows.groupBy("table_name").agg(F.count("*").alias("row_count"), F.count_if("has_embedding").alias("n_emb"), F.count_if("has_fts").alias("n_fts"))
    share = lambda c: F.when(F.col("row_count") == 0, 1.0).otherwise(F.col(c) / F.col("row_count"))
    return g.select("table_name", "row_count", F.round(share("n_emb"), 6).alias("embedding_coverage"), F.round(share("n_fts"), 6).alias("fts_coverage"), (share("n_emb") >= 1).alias("embedding_ready"), (share("n_fts") >= 1).alias("fts_ready"))


def bm25_ready(counts: DataFrame, lengths: DataFrame, queue: DataFrame) -> DataFrame:
    """Ready: nothing queued or in progress, and as many documents indexed as there are. counts: table_name, row_count; queue: table_name, status."""
    q = queue.groupBy("table_name").agg(F.count_if(F.col("status") == 0).alias("pending"), F.count_if(F.col("status") == 1).alias("in_progress"))
    t = counts.join(F.broadcast(lengths.select("table_name", "recordcount")), "table_name", "left").join(F.broadcast(q), "table_name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    ready = (zero("pending") == 0) & (zero("in_progress") == 0) & ((F.col("row_count") == 0) | (zero("recordcount") == F.col("row_count")))
    return t.select("table_name", "row_count", zero("recordcount").alias("recordcount"), zero("pending").alias("pending"), zero("in_progress").alias("in_progress"), ready.alias("bm25_ready"))


def reconcile_default(tables: DataFrame, status: DataFrame, preferred: str | None = None, home: str = "documents") -> DataFrame:
    """Each active table and whether it is the default from now on: the preferred one, the eligible default, the home table, the first eligible by name."""
    t = tables.where("is_active").join(F.broadcast(status.select("table_name", "search_eligible")), "table_name", "left").where(F.coalesce("search_eligible", F.lit(False)))
    rank = F.when(F.col("table_name") == F.lit(preferred), 0).when(F.col("is_default"), 1).when(F.col("table_name") == home, 2).otherwise(3)
    chosen = t.orderBy(rank, "table_name").limit(1).select(F.col("table_name").alias("chosen"))
    return tables.join(F.broadcast(chosen), F.col("table_name") == F.col("chosen"), "left").select("table_name", F.col("chosen").isNotNull().alias("is_default"))


def default_language(languages: DataFrame) -> DataFrame:
    rank = F.lit(len(LANGUAGE_PRIORITY) + 1)
    for k, name in enumerate(LANGUAGE_PRIORITY):
        rank = F.when(F.col("language") == name, F.lit(k + 1)).otherwise(rank)
    return languages.orderBy(rank, "language").limit(1).select("language", "table_suffix")


def percent(x):
    return F.concat(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) * 100, 0).cast("int").cast("string"), F.lit("%"))


def next_action(status: DataFrame) -> DataFrame:
    """What keeps a table from being searched. status: embedding_ready, fts_ready, bm25_ready, coverages, backfill_status, last_error."""
    issue = lambda cond, text: F.when(cond, text)
    issues = F.array_compact(F.array(issue(~F.col("embedding_ready"), F.concat(F.lit("embedding "), percent(F.col("embedding_coverage")))), issue(~F.col("fts_ready"), F.concat(F.lit("FTS "), percent(F.col("fts_coverage")))), issue(~F.col("bm25_ready"), F.lit("BM25 pending")), issue(F.col("backfill_status") == "running", F.lit("backfill running")), issue((F.col("backfill_status") == "error") & F.col("last_error").isNotNull(), F.lit("backfill error"))))
    ready = F.concat(F.lit("Ready for search · embedding "), percent(F.col("embedding_coverage")), F.lit(" · FTS "), percent(F.col("fts_coverage")))
    blocked = F.when(F.size(issues) > 0, F.concat(F.lit("Search blocked until "), F.array_join(issues, ", "), F.lit("."))).otherwise("Search blocked until table readiness checks pass.")
    return status.select("table_name", F.when(F.col("embedding_ready") & F.col("fts_ready") & F.col("bm25_ready"), ready).otherwise(blocked).alias("message"))
