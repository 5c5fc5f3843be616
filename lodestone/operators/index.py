"""The inverted index: token, length and document-frequency tables; full builds, change consolidation, deltas and their application.

Token tables are keyed by (table_name, id), as ids need not be unique across tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

KEY = ["table_name", "id"]


def analysed(df: DataFrame, table_name: str, id_col: str = "id", text_col: str = "content", fts_col: str | None = None) -> DataFrame:
    """table_name, id, tokens, len: what the index builds read; tokens that are stored already (fts_col) aren't made again. No shuffle."""
    t = T.tokens(F.col(text_col)) if fts_col is None else F.coalesce(F.col(fts_col), T.tokens(F.col(text_col)))
    return df.select(F.lit(table_name).alias("table_name"), F.col(id_col).cast("long").alias("id"), t.alias("tokens")).withColumn("len", T.text_length(F.col("tokens")))


def cleaned(df: DataFrame, table_name: str, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """table_name, id, tokens as text: the same words with white space between, for builds that cut them and count lengths themselves."""
    return df.select(F.lit(table_name).alias("table_name"), F.col(id_col).cast("long").alias("id"), T.only_words(F.col(text_col)).alias("tokens"))


def counted(tokens: Column) -> Column:
    """Array of (token, tf), from the runs of equal tokens in order; null and empty give an empty one."""

    def runs(some: Column) -> Column:
        n = F.size(some)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: (n >= i) & ((i == 1) | (F.get(some, i - 1) != F.get(some, i - 2))))
        token = lambda at, ends: F.zip_with(at, ends, lambda a, b: F.struct(F.get(some, a - 1).alias("token"), (F.coalesce(b, n + 1) - a).cast("long").alias("tf")))
        return once(starts, lambda at: token(at, F.slice(at, 2, 1 << 30)))

    return once(F.sort_array(F.coalesce(tokens, F.array().cast("array<string>"))), runs)


def once(value: Column, use) -> Column:
    """use(value), with the value computed once a row: an expression that is used in a lambda is else computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def token_stats(docs: DataFrame, *more: str) -> DataFrame:
    """table_name, id, token, tf. All tokens of a document are in its row, so nothing is shuffled."""
    return docs.select(*KEY, *more, F.inline(counted(F.col("tokens"))))


def lengths(docs: DataFrame) -> DataFrame:
    return docs.groupBy("table_name").agg(F.count("*").alias("recordcount"), F.coalesce(F.sum(F.coalesce("len", F.lit(0))), F.lit(0)).alias("sumlen"), F.coalesce(F.avg(F.coalesce("len", F.lit(0))), F.lit(0.0)).alias("avglen"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """token, tfdoc. A document's distinct tokens are made in its row, so the one shuffle has a row per token and task."""
    return docs.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("tfdoc"))


def parse_tsvector(v: Column) -> Column:
    """Array of (token, tf) of 'lexeme':positions text; without positions tf is 1."""
    pattern = F.lit(LEXEME)
    pairs = F.arrays_zip(F.regexp_extract_all(v, pattern, F.lit(1)).alias("token"), F.regexp_extract_all(v, pattern, F.lit(2)).alias("at"))
    return F.transform(pairs, lambda p: F.struct(F.replace(p["token"], F.lit("''"), F.lit("'")).alias("token"), F.when(p["at"] == "", 1).otherwise(F.size(F.split(p["at"], ","))).alias("tf")))


#: Lexemes in quotes (doubled within) with their places; the second group is empty where there are none.
LEXEME = r"'((?:[^']|'')+)'(?::([0-9,]+))?"


def register_token_stats(spark) -> None:
    """The table function tsvector_token_stats(v) -> (token, tf) for SQL."""
    found = ", ".join(f'regexp_extract_all(v, r"{LEXEME}", {k})' for k in (1, 2))
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION tsvector_token_stats(v STRING) RETURNS TABLE(token STRING, tf INT)
        RETURN SELECT p.token, p.tf FROM (SELECT explode(transform(arrays_zip({found}),
            t -> named_struct('token', replace(t.`0`, "''", "'"), 'tf', if(t.`1` = '', 1, size(split(t.`1`, ',')))))) AS p)""")


def consolidate(log: DataFrame) -> DataFrame:
    """One row per document: the oldest task's old state and the newest task's new state."""
    return log.groupBy(*KEY).agg(F.min_by("old_len", "row_id").alias("initial_len"), F.min_by("old_tokens", "row_id").alias("initial_tokens"), F.max_by("new_len", "row_id").alias("final_len"), F.max_by("new_tokens", "row_id").alias("final_tokens"), F.count("*").alias("n_tasks"))


def length_deltas(tasks: DataFrame) -> DataFrame:
    record = F.when(F.col("initial_len").isNull() & F.col("final_len").isNotNull(), 1).when(F.col("initial_len").isNotNull() & F.col("final_len").isNull(), -1).otherwise(0)
    return tasks.groupBy("table_name").agg(F.sum(record).alias("record_delta"), F.sum(F.coalesce("final_len", F.lit(0)) - F.coalesce("initial_len", F.lit(0))).cast("long").alias("sumlen_delta"))


def _signed(tasks: DataFrame, distinct: bool) -> DataFrame:
    take = F.array_distinct if distinct else (lambda c: F.col(c))
    side = lambda c, sign: tasks.select(F.explode(take(c)).alias("token"), F.lit(sign).alias("sign"))
    return side("final_tokens", 1).unionByName(side("initial_tokens", -1)).groupBy("token").agg(F.sum("sign").alias("delta")).where("delta <> 0")


def token_deltas(tasks: DataFrame) -> DataFrame:
    return _signed(tasks, distinct=False)


def df_deltas(tasks: DataFrame) -> DataFrame:
    return _signed(tasks, distinct=True)


def apply_lengths(table: DataFrame, deltas: DataFrame) -> DataFrame:
    j = table.join(deltas, "table_name", "full_outer")
    count = F.greatest(F.lit(0), F.coalesce("recordcount", F.lit(0)) + F.coalesce("record_delta", F.lit(0)))
    total = F.greatest(F.lit(0), F.coalesce("sumlen", F.lit(0)) + F.coalesce("sumlen_delta", F.lit(0)))
    return j.select("table_name", count.alias("recordcount"), total.alias("sumlen")).withColumn("avglen", F.when(F.col("recordcount") > 0, F.col("sumlen") / F.col("recordcount")).otherwise(0.0))


def apply_tokens(table: DataFrame, tasks: DataFrame) -> DataFrame:
    new = token_stats(tasks.where("final_tokens IS NOT NULL").select(*KEY, F.col("final_tokens").alias("tokens")))
    return table.join(tasks.select(*KEY), KEY, "left_anti").unionByName(new)


def apply_df(table: DataFrame, deltas: DataFrame) -> DataFrame:
    j = table.join(deltas, "token", "full_outer")
    return j.select("token", F.greatest(F.lit(0), F.coalesce("tfdoc", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("tfdoc")).where("tfdoc > 0")


def corpus_stats(length_table: DataFrame, table_name: str) -> DataFrame:
    """n over all tables of the language, avglen of this one."""
    return length_table.agg(F.sum("recordcount").alias("n"), F.max(F.when(F.col("table_name") == table_name, F.col("avglen"))).alias("avglen"))
