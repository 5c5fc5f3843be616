"""All queries of the search and corpus operators by name, and their SQL for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name; views that SQL strings name are spelled out by `views`."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"{VIEWS} {sql}" if any(re.search(rf"(FROM|JOIN) {v}\b", sql) for v in ("docs", "corpus", "vec", "an", "final_an", "scope", "logs", "changes", "cons")) else sql
        return f

    return add


TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda t: length(t) > 0)"

#: docs: canonical documents; vec: vectors by id; an: analysed documents, scope: with benchmark; logs, changes: the change log; cons: consolidated.
VIEWS = f"""
WITH docs AS (SELECT doc_id AS id, left(split_part(text, chr(10), 1), 80) AS title, text AS content, source AS namespace, CAST(NULL AS VARCHAR) AS contributors, lang AS language FROM documents),
vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS embedding FROM embeddings),
corpus AS (SELECT docs.*, vec.embedding FROM docs LEFT JOIN vec ON vec.id = docs.id),
an AS (SELECT 'documents' AS table_name, doc_id AS id, {TOKENS.format("text")} AS tokens FROM documents),
scope AS (SELECT * FROM an UNION ALL SELECT 'benchmark', item_id, {TOKENS.format("text")} FROM benchmark),
half AS (SELECT doc_id AS id, {TOKENS.format("left(text, length(text) // 2)")} AS tokens FROM documents),
logs AS (
  SELECT an.id AS row_id, 0 AS task_type, an.table_name, an.id, NULL::BIGINT AS old_len, NULL::VARCHAR[] AS old_tokens, len(list_distinct(an.tokens)) AS new_len, an.tokens AS new_tokens FROM an
  UNION ALL SELECT 1000000000 + an.id, 1, an.table_name, an.id, len(list_distinct(an.tokens)), an.tokens, len(list_distinct(half.tokens)), half.tokens FROM an JOIN half ON half.id = an.id WHERE an.id % 5 = 0
  UNION ALL SELECT 2000000000 + an.id, 2, an.table_name, an.id, len(list_distinct(o.tokens)), o.tokens, NULL, NULL FROM an JOIN (SELECT an.id, CASE WHEN an.id % 5 = 0 THEN half.tokens ELSE an.tokens END AS tokens FROM an JOIN half ON half.id = an.id) o ON o.id = an.id WHERE an.id % 7 = 0),
changes AS (SELECT * FROM logs WHERE task_type > 0),
firsts AS (SELECT *, row_number() OVER (PARTITION BY table_name, id ORDER BY row_id) AS r, row_number() OVER (PARTITION BY table_name, id ORDER BY row_id DESC) AS z, count(*) OVER (PARTITION BY table_name, id) AS n FROM changes),
cons AS (SELECT a.table_name, a.id, a.old_len AS initial_len, a.old_tokens AS initial_tokens, b.new_len AS final_len, b.new_tokens AS final_tokens, a.n AS n_tasks FROM firsts a JOIN firsts b ON a.table_name = b.table_name AND a.id = b.id AND a.r = 1 AND b.z = 1),
final_an AS (SELECT an.table_name, an.id, CASE WHEN an.id % 5 = 0 THEN half.tokens ELSE an.tokens END AS tokens FROM an JOIN half ON half.id = an.id WHERE an.id % 7 <> 0)
"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The modules register their queries when they are imported.
from . import corpus_queries, index_queries, search_queries, status_queries, text_queries, vector_queries  # noqa: E402, F401
