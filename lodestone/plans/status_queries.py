"""Queries over the catalog, readiness, telemetry and evaluation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..operators import backfill, catalog, corpus, evaluate, index
from . import inputs as X
from .index_queries import LENGTHS
from .registry import query

STATUS = [("documents", 1000, 1.0, 1.0, True, True, True, True), ("benchmark", 40, 0.0, 1.0, False, True, True, False), ("pages", 250, 1.0, 1.0, True, True, True, True)]
STATUS_COLUMNS = "table_name, row_count, embedding_coverage, fts_coverage, embedding_ready, fts_ready, bm25_ready, search_eligible"
STATUS_SCHEMA = "table_name string, row_count long, embedding_coverage double, fts_coverage double, embedding_ready boolean, fts_ready boolean, bm25_ready boolean, search_eligible boolean"
SQL_STATUS = X.values(STATUS, STATUS_COLUMNS)
JOINED = f"{X.SQL_TABLES} t LEFT JOIN {X.SQL_LANGUAGES} l USING (language) LEFT JOIN {X.SQL_SETTINGS} s USING (language) LEFT JOIN {SQL_STATUS} u USING (table_name)"


def _status(spark):
    return spark.createDataFrame(STATUS, STATUS_SCHEMA)


@query(f"SELECT table_name, language, table_suffix, k1::DOUBLE AS k1, b::DOUBLE AS b, is_default FROM {JOINED} WHERE is_active AND search_eligible ORDER BY is_default DESC, table_name LIMIT 1")
def resolve_context(spark, d):
    return catalog.resolve_context(X.tables(spark), X.languages(spark), X.settings(spark), _status(spark))


@query(f"SELECT table_name, language, table_suffix, k1::DOUBLE AS k1, b::DOUBLE AS b, is_default, is_active, coalesce(row_count, 0)::BIGINT AS row_count, coalesce(embedding_coverage, 0)::DOUBLE AS embedding_coverage, coalesce(search_eligible, FALSE) AS search_eligible FROM {JOINED}")
def managed_tables_summary(spark, d):
    return catalog.tables_summary(X.tables(spark), X.languages(spark), X.settings(spark), _status(spark))


@query(f"""SELECT l.language, l.table_suffix, s.k1::DOUBLE AS k1, s.b::DOUBLE AS b, count(t.table_name) AS tables, coalesce(sum(n.recordcount), 0)::BIGINT AS documents, coalesce(sum(n.sumlen), 0)::BIGINT AS sumlen, round(coalesce(avg(n.avglen), 0), 6) AS avglen
    FROM {X.SQL_LANGUAGES} l JOIN {X.SQL_SETTINGS} s USING (language) LEFT JOIN {X.SQL_TABLES} t ON t.language = l.language AND t.is_active LEFT JOIN {LENGTHS.format('scope ')} n ON n.table_name = t.table_name GROUP BY ALL""")
def language_summary(spark, d):
    return catalog.language_summary(X.languages(spark), X.settings(spark), X.tables(spark), index.lengths(X.scope(spark, d)))


@query("""SELECT table_name, row_count, round(CASE WHEN row_count = 0 THEN 1 ELSE e / row_count END, 6) AS embedding_coverage, round(CASE WHEN row_count = 0 THEN 1 ELSE f / row_count END, 6) AS fts_coverage, e >= row_count AS embedding_ready, f >= row_count AS fts_ready
    FROM (SELECT 'documents' AS table_name, count(*) AS row_count, count(embedding)::DOUBLE AS e, count(content)::DOUBLE AS f FROM corpus)""")
def coverage_status(spark, d):
    rows = X.docs(spark, d).select("id", "content").join(X.vectors(spark, d), "id", "left")
    return catalog.coverage(rows.select(F.lit("documents").alias("table_name"), F.col("embedding").isNotNull().alias("has_embedding"), F.col("content").isNotNull().alias("has_fts")))


@query(f"SELECT table_name, table_name = 'pages' AS is_default FROM {X.SQL_TABLES}")
def default_reconcile(spark, d):
    return catalog.reconcile_default(X.tables(spark), _status(spark), preferred="pages")


@query(f"SELECT language, table_suffix FROM {X.SQL_LANGUAGES} ORDER BY CASE language WHEN 'korean' THEN 1 WHEN 'english' THEN 2 WHEN 'japanese' THEN 3 WHEN 'chinese' THEN 4 ELSE 5 END, language LIMIT 1")
def default_language(spark, d):
    return catalog.default_language(X.languages(spark))


@query(f"SELECT table_name, language, is_default FROM {X.SQL_TABLES} WHERE table_name = 'pages' AND is_active")
def registry_lookup(spark, d):
    return X.tables(spark).where("table_name = 'pages' AND is_active").select("table_name", "language", "is_default")


@query(f"SELECT coalesce(t.table_name, n.table_name) AS table_name, coalesce(n.language, t.language) AS language, coalesce(t.is_default, FALSE) AS is_default, coalesce(n.is_active, t.is_active) AS is_active FROM {X.SQL_TABLES} t FULL JOIN (SELECT * FROM (VALUES ('pages', 'korean', TRUE, TRUE), ('notes', 'simple', FALSE, TRUE)) AS v(table_name, language, is_default, is_active)) n USING (table_name)")
def registry_upsert(spark, d):
    """A table registered again keeps whether it is the default."""
    new = spark.createDataFrame([("pages", "korean", True, True), ("notes", "simple", False, True)], "table_name string, language string, is_default boolean, is_active boolean")
    return corpus.upsert(X.tables(spark), new, "table_name", keep=["is_default"])


RUNS = [("documents", "running", 1000, 250, None), ("benchmark", "completed", 40, 40, None), ("pages", "error", 250, 260, "lost"), ("conversations", "idle", 0, 0, None)]
RUN_COLUMNS = "table_name, status, total_rows, processed_rows, last_error"


def _runs(spark):
    return spark.createDataFrame(RUNS, "table_name string, status string, total_rows long, processed_rows long, last_error string")


@query(f"SELECT table_name, status, total_rows::BIGINT AS total_rows, processed_rows::BIGINT AS processed_rows, greatest(total_rows - processed_rows, 0)::BIGINT AS remaining_rows FROM {X.values(RUNS, RUN_COLUMNS)}")
def backfill_status(spark, d):
    return backfill.status(_runs(spark))


@query(f"""SELECT table_name, CASE WHEN embedding_ready AND fts_ready AND bm25_ready THEN 'Ready for search · embedding ' || round(100 * embedding_coverage)::INT || '% · FTS ' || round(100 * fts_coverage)::INT || '%'
    ELSE 'Search blocked until ' || concat_ws(', ', CASE WHEN NOT embedding_ready THEN 'embedding ' || round(100 * embedding_coverage)::INT || '%' END, CASE WHEN NOT fts_ready THEN 'FTS ' || round(100 * fts_coverage)::INT || '%' END, CASE WHEN NOT bm25_ready THEN 'BM25 pending' END, CASE WHEN status = 'running' THEN 'backfill running' END, CASE WHEN status = 'error' AND last_error IS NOT NULL THEN 'backfill error' END) || '.' END AS message
    FROM {SQL_STATUS} JOIN {X.values(RUNS, RUN_COLUMNS)} r USING (table_name)""")
def next_action(spark, d):
    return catalog.next_action(_status(spark).join(_runs(spark).withColumnRenamed("status", "backfill_status"), "table_name"))


P95 = "SELECT event_type, n, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE r = {0}"


@query(P95.format("greatest(1, floor(n * 0.95::DOUBLE))"))
def p95_nearest_rank(spark, d):
    return evaluate.nearest_rank(X.load(spark, d, "events"), "event_type", "value", evaluate.p95_place)


@query(f"SELECT a.event_type, a.n, a.value AS p50, b.value AS p95 FROM ({P95.format('least(n, floor(n * 0.5::DOUBLE) + 1)')}) a JOIN ({P95.format('least(n, floor(n * 0.95::DOUBLE) + 1)')}) b USING (event_type)")
def latency_percentiles(spark, d):
    e = X.load(spark, d, "events")
    half = evaluate.nearest_rank(e, "event_type", "value", evaluate.floor_place(0.5)).withColumnRenamed("value", "p50")
    return half.join(evaluate.nearest_rank(e, "event_type", "value", evaluate.floor_place(0.95)).select("event_type", F.col("value").alias("p95")), "event_type")


@query("SELECT event_type AS query, count(*) AS calls, round(sum(value), 2) AS total_ms, round(avg(value), 2) AS mean_ms FROM events GROUP BY event_type ORDER BY total_ms DESC LIMIT 30")
def ops_top_queries(spark, d):
    return X.load(spark, d, "events").groupBy(F.col("event_type").alias("query")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("total_ms"), F.round(F.avg("value"), 2).alias("mean_ms")).orderBy(F.desc("total_ms")).limit(30)


STATEMENT = "CASE event_type WHEN 'view' THEN 'SELECT id FROM docs ORDER BY v <=> q' WHEN 'click' THEN 'SET hnsw.ef_search = 40' WHEN 'error' THEN 'SET IVFFLAT.probes = 3' WHEN 'signup' THEN 'SELECT a <-> b' ELSE 'SELECT 1' END"


@query(f"SELECT query, count(*) AS calls, round(stddev_samp(value), 2) AS stddev_ms FROM (SELECT {STATEMENT} AS query, value FROM events) WHERE query ILIKE '%<->%' OR query ILIKE '%<=>%' OR query ILIKE '%hnsw.ef_search%' OR query ILIKE '%ivfflat.probes%' GROUP BY query")
def ops_vector_hotspots(spark, d):
    e = X.load(spark, d, "events").select(F.expr(STATEMENT).alias("query"), "value")
    hot = F.lit(False)
    for p in ("%<->%", "%<=>%", "%hnsw.ef_search%", "%ivfflat.probes%"):
        hot = hot | F.col("query").ilike(p)
    return e.where(hot).groupBy("query").agg(F.count("*").alias("calls"), F.round(F.stddev_samp("value"), 2).alias("stddev_ms"))


@query("""SELECT count(*) AS total_queries, count(*) FILTER (WHERE ok) AS ok_queries, count(*) FILTER (WHERE NOT ok) AS error_queries, round(avg(took) FILTER (WHERE ok), 2) AS avg_took_ms, count(*) FILTER (WHERE ok AND coverage < 0.34) AS low_coverage, round(count(*) FILTER (WHERE ok AND coverage < 0.34) / count(*) FILTER (WHERE ok), 4) AS low_coverage_rate
    FROM (SELECT event_type <> 'error' AS ok, value AS took, round((event_id % 4) / 3.0::DOUBLE, 3) AS coverage FROM events)""")
def quality_summary(spark, d):
    rows = X.load(spark, d, "events").select((F.col("event_type") != "error").alias("ok"), F.col("value").alias("took"), F.round((F.col("event_id") % 4) / 3.0, 3).alias("coverage"))
    low = F.count_if(F.col("ok") & (F.col("coverage") < 0.34))
    return rows.agg(F.count("*").alias("total_queries"), F.count_if("ok").alias("ok_queries"), F.count_if(~F.col("ok")).alias("error_queries"), F.round(F.avg(F.when(F.col("ok"), F.col("took"))), 2).alias("avg_took_ms"), low.alias("low_coverage"), F.round(low / F.nullif(F.count_if("ok"), F.lit(0)), 4).alias("low_coverage_rate"))


@query("SELECT r_name, CAST(to_json(list({'id': n_nationkey, 'name': n_name} ORDER BY n_nationkey)) AS VARCHAR) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def json_groups(spark, d):
    """Each region's nations as one JSON array."""
    n = X.load(spark, d, "nation").join(F.broadcast(X.load(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    return n.groupBy("r_name").agg(sinks.json_array(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), F.col("n_nationkey")).alias("nations"))


@query("SELECT CAST(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars}) AS VARCHAR) AS json FROM documents")
def json_export(spark, d):
    """Rows as JSON objects."""
    return sinks.json_rows(X.load(spark, d, "documents").select("doc_id", "lang", "n_chars"))


@query("SELECT CAST(to_json({'total': (SELECT count(*) FROM documents), 'vectors': (SELECT count(*) FROM embeddings)}) AS VARCHAR) AS summary")
def json_summary(spark, d):
    a = X.load(spark, d, "documents").agg(F.count("*").alias("total"))
    b = X.load(spark, d, "embeddings").agg(F.count("*").alias("vectors"))
    return a.crossJoin(F.broadcast(b)).select(sinks.json_object(total=F.col("total"), vectors=F.col("vectors")).alias("summary"))  # a row each
