"""A training-data pipeline over the documents table: each stage works on all its predecessor kept.

Stages: documents in no language go, the others get theirs as lang; of each group of
near-duplicates the row with the smallest doc_id stays; secrets in texts are replaced; sources are mixed to target weights; what is
left is encoded to token ids. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, jaccard, language, mixing, secret_scan
from lodestone.llm.queries import vocabulary
from lodestone.llm.runtime import shared_dir, written

#: Weights that follow the corpus: domains and languages by rule, sources of a language alike; no document twice.
MIX = mixing.Mix(budget=90, epochs=1)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier in the languages learned than as letters alone, each with its likeliest language as lang; those without text or letters go."""
    return language.label(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the one with the smallest doc_id, then with the smallest row key; one without a doc_id only where no row has one.

    Rows are told apart by all their columns, so rows that share a doc_id and differ in text are documents of their own.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("own"), F.xxhash64(*columns, *[c.isNull() for c in columns]).alias("row"), F.hash(*columns).alias("more"))
    linked = jaccard.link(keyed.select("row", F.col("own.text").alias("text")), id_col="row").select(F.col("doc_id").alias("row"), "component_id").distinct()
    ids = keyed.select("row", F.col("own.doc_id").cast("long").alias("id")).distinct()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    keep = linked.join(ids, "row").groupBy("component_id").agg(first.alias("first")).select("first.row")
    return keyed.join(keep, "row", "left_semi").dropDuplicates(["row", "more"]).select("own.*")


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced and n_chars counted anew."""
    return secret_scan.redact_secrets(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to the target weights."""
    return mixing.mix(docs, MIX, added=False)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the columns that name it."""
    path = vocabulary("word_bpe_49k.json")
    return bpe.encode(docs, path, bpe.compile_lexicon(docs, path)).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language identification", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", replace_secrets),
    ("mixing to target weights", mix_sources),
    ("BPE encoding", encode_ids),
]

#: The stages aren't SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
