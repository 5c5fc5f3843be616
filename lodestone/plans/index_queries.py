"""Queries that build and maintain the inverted index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, index
from . import inputs as X
from .registry import query

STATS = "(SELECT table_name, id, token, count(*) AS tf FROM (SELECT table_name, id, unnest(tokens) AS token FROM {0}) GROUP BY ALL)"
LENGTHS = "(SELECT table_name, count(*) AS recordcount, sum(len(list_distinct(tokens)))::BIGINT AS sumlen, avg(len(list_distinct(tokens))) AS avglen FROM {0} GROUP BY table_name)"
DF = "(SELECT token, count(*) AS tfdoc FROM (SELECT DISTINCT table_name, id, unnest(tokens) AS token FROM {0}) GROUP BY token)"


@query(f"SELECT * FROM {STATS.format('an ')}")
def token_stats(spark, d):
    return index.token_stats(X.analysed(spark, d))


@query(f"SELECT * FROM {STATS.format('scope ')}")
def bm25_build_tokens(spark, d):
    return index.token_stats(X.scope(spark, d))


@query(f"SELECT table_name, recordcount, sumlen, round(avglen, 6) AS avglen FROM {LENGTHS.format('scope ')}")
def bm25_build_length(spark, d):
    return index.lengths(X.scope(spark, d)).withColumn("avglen", F.round("avglen", 6))


@query(f"SELECT * FROM {DF.format('scope ')}")
def bm25_build_idf(spark, d):
    return index.document_frequency(X.scope(spark, d))


@query("SELECT id, len(list_distinct(tokens)) AS textlen FROM an")
def doc_textlen(spark, d):
    return X.analysed(spark, d).select("id", F.col("len").cast("long").alias("textlen"))


@query(f"SELECT sum(recordcount)::BIGINT AS n, round(max(CASE WHEN table_name = 'documents' THEN avglen END), 6) AS avglen FROM {LENGTHS.format('scope ')}")
def bm25_corpus_stats(spark, d):
    return index.corpus_stats(index.lengths(X.scope(spark, d)), "documents").withColumn("avglen", F.round("avglen", 6))


@query(f"SELECT count(*) AS tables, sum(recordcount)::BIGINT AS documents, sum(sumlen)::BIGINT AS sumlen, round(avg(avglen), 6) AS avglen FROM {LENGTHS.format('scope ')}")
def bm25_length_summary(spark, d):
    return index.lengths(X.scope(spark, d)).agg(F.count("*").alias("tables"), F.sum("recordcount").alias("documents"), F.sum("sumlen").alias("sumlen"), F.round(F.avg("avglen"), 6).alias("avglen"))


VECTOR_TEXT = "'''' || replace(token, '''', '''''') || ''':' || array_to_string(range(1, tf + 1), ',')"


def _vectors(an):
    """id and v: the tokens of a document as lexeme text."""
    entry = lambda p: F.concat(F.lit("'"), F.replace(p["token"], F.lit("'"), F.lit("''")), F.lit("'"), F.when(p["tf"] > 1, F.concat(F.lit(":"), F.array_join(F.sequence(F.lit(1), p["tf"]), ","))).otherwise(""))
    return an.select("id", F.array_join(F.transform(index.counted(F.col("tokens")), entry), " ").alias("v"))


PARSED = "SELECT id, token, count(*)::INT AS tf FROM (SELECT id, unnest(tokens) AS token FROM an) GROUP BY ALL"


@query(PARSED)
def tsvector_parse(spark, d):
    """Token lists of all documents written as lexeme text and parsed back."""
    return _vectors(X.analysed(spark, d)).select("id", F.inline(index.parse_tsvector(F.col("v"))))


@query(PARSED)
def token_stats_function(spark, d):
    """The same by the SQL table function."""
    index.register_token_stats(spark)
    return spark.sql("SELECT d.id, s.token, s.tf FROM {vectors} d, LATERAL tsvector_token_stats(d.v) s", vectors=_vectors(X.analysed(spark, d)))


@query(f"SELECT * FROM {STATS.format('scope ')}")
def stored_tokens(spark, d):
    """The token rows of the stored index."""
    return X.index(spark, d).tokens().drop("len")


@query(f"SELECT 'tokens' AS \"table\", count(*) AS rows FROM {STATS.format('scope ')} UNION ALL SELECT 'frequency', count(*) FROM {DF.format('scope ')} UNION ALL SELECT 'lengths', count(*) FROM {LENGTHS.format('scope ')}")
def ops_index_usage(spark, d):
    """What the stored index holds."""
    return X.index(spark, d).usage()


@query("SELECT DISTINCT table_name FROM (SELECT table_name FROM logs WHERE task_type <> 1 ORDER BY row_id LIMIT 100)")
def chunk_tables(spark, d):
    """The tables that a claimed chunk touches."""
    waiting = X.log(spark, d).where("task_type <> 1").orderBy("row_id").limit(100)
    return waiting.select("table_name").distinct()


@query("SELECT row_id, task_type, table_name, id, old_len, new_len FROM logs")
def task_log(spark, d):
    return X.log(spark, d).select("row_id", "task_type", "table_name", "id", F.col("old_len").cast("long").alias("old_len"), F.col("new_len").cast("long").alias("new_len"))


@query("SELECT table_name, id, initial_len, final_len, n_tasks FROM cons")
def task_consolidate(spark, d):
    return X.consolidated(spark, d).select("table_name", "id", F.col("initial_len").cast("long").alias("initial_len"), F.col("final_len").cast("long").alias("final_len"), "n_tasks")


@query("SELECT table_name, sum(CASE WHEN initial_len IS NULL AND final_len IS NOT NULL THEN 1 WHEN initial_len IS NOT NULL AND final_len IS NULL THEN -1 ELSE 0 END)::BIGINT AS record_delta, sum(coalesce(final_len, 0) - coalesce(initial_len, 0))::BIGINT AS sumlen_delta FROM cons GROUP BY table_name")
def length_deltas(spark, d):
    return index.length_deltas(X.consolidated(spark, d))


SIGNED = "(SELECT token, sum(sign)::BIGINT AS delta FROM (SELECT unnest({0}(final_tokens)) AS token, 1 AS sign FROM cons UNION ALL SELECT unnest({0}(initial_tokens)), -1 FROM cons) GROUP BY token HAVING sum(sign) <> 0)"


@query(f"SELECT * FROM {SIGNED.format('')}")
def token_deltas(spark, d):
    return index.token_deltas(X.consolidated(spark, d))


@query(f"SELECT * FROM {SIGNED.format('list_distinct')}")
def df_deltas(spark, d):
    return index.df_deltas(X.consolidated(spark, d))


@query(f"SELECT table_name, recordcount, sumlen, round(avglen, 6) AS avglen FROM {LENGTHS.format('final_an')}")
def bm25_apply_length(spark, d):
    return index.apply_lengths(index.lengths(X.analysed(spark, d)), index.length_deltas(X.consolidated(spark, d))).withColumn("avglen", F.round("avglen", 6))


@query(f"SELECT * FROM {STATS.format('final_an')}")
def bm25_apply_tokens(spark, d):
    return index.apply_tokens(index.token_stats(X.analysed(spark, d)), X.consolidated(spark, d))


@query(f"SELECT * FROM {DF.format('final_an')}")
def bm25_apply_idf(spark, d):
    return index.apply_df(index.document_frequency(X.analysed(spark, d)), index.df_deltas(X.consolidated(spark, d)))


@query(f"SELECT 'df' AS part, 0::BIGINT AS differences, count(*) AS entries FROM {DF.format('final_an')} UNION ALL SELECT 'length', 0, count(*) FROM {LENGTHS.format('final_an')}")
def bm25_incremental_equals_full(spark, d):
    """The index after applied deltas against a full build of the final state: entries, and how many differ."""
    full = index.document_frequency(X.final_state(spark, d)).select("token", F.col("tfdoc").alias("full"))
    df = bm25_apply_idf(spark, d).join(full, "token", "full_outer").agg(F.count_if(~F.col("tfdoc").eqNullSafe(F.col("full"))).alias("differences"), F.count("*").alias("entries"))
    whole = index.lengths(X.final_state(spark, d)).select("table_name", F.col("recordcount").alias("r"), F.col("sumlen").alias("s"))
    length = bm25_apply_length(spark, d).join(whole, "table_name", "full_outer").agg(F.count_if(~(F.col("recordcount").eqNullSafe(F.col("r")) & F.col("sumlen").eqNullSafe(F.col("s")))).alias("differences"), F.count("*").alias("entries"))
    return df.select(F.lit("df").alias("part"), "*").unionByName(length.select(F.lit("length").alias("part"), "*"))


@query("SELECT row_id, id FROM logs WHERE task_type <> 1 ORDER BY row_id LIMIT 100")
def queue_claim(spark, d):
    """The oldest waiting tasks; updates stand for those done."""
    waiting = X.log(spark, d).select("row_id", "id", F.when(F.col("task_type") == 1, 2).otherwise(0).alias("status")).where("status = 0")
    return waiting.orderBy("row_id").limit(100).select("row_id", "id")


@query("SELECT task_type AS status, count(*) AS tasks FROM logs GROUP BY task_type")
def queue_counts(spark, d):
    return X.log(spark, d).groupBy(F.col("task_type").alias("status")).agg(F.count("*").alias("tasks"))


@query(f"""SELECT t.table_name, t.row_count, coalesce(l.recordcount, 0) AS recordcount, coalesce(q.pending, 0) AS pending, coalesce(q.in_progress, 0) AS in_progress,
    coalesce(q.pending, 0) = 0 AND coalesce(q.in_progress, 0) = 0 AND (t.row_count = 0 OR coalesce(l.recordcount, 0) = t.row_count) AS bm25_ready
    FROM (SELECT 'documents' AS table_name, count(*) AS row_count FROM documents UNION ALL SELECT 'benchmark', count(*) FROM benchmark UNION ALL SELECT 'pages', count(*) FROM pages) t
    LEFT JOIN {LENGTHS.format('scope ')} l USING (table_name)
    LEFT JOIN (SELECT table_name, count(*) FILTER (WHERE task_type = 0) AS pending, count(*) FILTER (WHERE task_type = 1) AS in_progress FROM logs GROUP BY table_name) q USING (table_name)""")
def bm25_ready(spark, d):
    counts = None
    for t in ("documents", "benchmark", "pages"):
        c = X.load(spark, d, t).agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
        counts = c if counts is None else counts.unionByName(c)
    return catalog.bm25_ready(counts, index.lengths(X.scope(spark, d)), X.log(spark, d).select("table_name", F.col("task_type").alias("status")))


@query(f"SELECT 'english' AS language, (SELECT sum(recordcount)::BIGINT FROM {LENGTHS.format('scope ')}) AS documents, (SELECT count(*) FROM {DF.format('scope ')}) AS tokens, (SELECT count(*) FROM logs WHERE task_type = 0) AS pending, (SELECT count(*) FROM logs WHERE task_type = 1) AS in_progress, (SELECT count(*) FROM logs WHERE task_type = 2) AS completed")
def bm25_language_status(spark, d):
    docs = index.lengths(X.scope(spark, d)).agg(F.sum("recordcount").alias("documents"))
    tokens = index.document_frequency(X.scope(spark, d)).agg(F.count("*").alias("tokens"))
    q = X.log(spark, d).agg(*[F.count_if(F.col("task_type") == k).alias(n) for k, n in enumerate(("pending", "in_progress", "completed"))])
    return docs.crossJoin(F.broadcast(tokens)).crossJoin(F.broadcast(q)).select(F.lit("english").alias("language"), "*")  # a row each
