"""Queries that read, change and back-fill the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backfill, corpus, keyed
from . import inputs as X
from .registry import TOKENS, query

HASH = "sha256(coalesce(title, '') || chr(10) || content)"


@query("SELECT id, title, content, namespace FROM docs WHERE content <> ''")
def ingest_scan(spark, d):
    return X.docs(spark, d).where("content IS NOT NULL AND content <> ''").select("id", "title", "content", "namespace")


@query("SELECT least(count(*), 750) AS target FROM documents")
def ingest_target_rows(spark, d):
    return X.load(spark, d, "documents").agg(F.least(F.count("*"), F.lit(750).cast("long")).alias("target"))


@query(f"""SELECT coalesce(t.id, s.id) AS id, h AS doc_hash, coalesce(s.namespace, t.namespace) AS namespace FROM
    (SELECT {HASH} AS h, min(id) AS id, arg_min(namespace, id) AS namespace FROM docs WHERE id % 3 <> 0 GROUP BY h) t FULL JOIN
    (SELECT {HASH} AS h, max(id) AS id, arg_max('new-' || namespace, id) AS namespace FROM docs WHERE id % 2 = 0 GROUP BY h) s USING (h)""")
def upsert_documents(spark, d):
    """Every second document over those that aren't every third; the last write of a hash wins, ids stay."""
    rows = X.docs(spark, d).select("id", "doc_hash", "namespace")
    target = rows.where("id % 3 <> 0").groupBy("doc_hash").agg(F.min("id").alias("id"), F.min_by("namespace", "id").alias("namespace")).select("id", "doc_hash", "namespace")
    source = corpus.last_write(rows.where("id % 2 = 0"), "doc_hash", "id").withColumn("namespace", F.concat(F.lit("new-"), F.col("namespace")))
    return corpus.upsert(target, source, "doc_hash", keep=["id"])


@query("SELECT id, title, CASE WHEN id % 100 < 2 THEN 'changed' ELSE namespace END AS namespace FROM docs WHERE id % 11 <> 0 OR id % 100 < 2")
def upsert_touched(spark, d):
    """Documents in files by id; those at the start of each hundred changed, each eleventh deleted, by rewriting files that hold some only."""
    rows = X.docs(spark, d).select("id", "title", "namespace")

    def make(folder):
        table = keyed.Keyed(spark, folder)
        table.create(rows, 16)
        table.upsert(rows.where("id % 100 < 2").withColumn("namespace", F.lit("changed")), lambda own, source: corpus.upsert(own, source, "id", keep=[]))
        gone = rows.where("id % 11 = 0 AND id % 100 >= 2").select("id")
        table.change(gone, lambda own: corpus.delete(own, gone))
        return table

    return X.built(spark, d, "keyed", make).read()


@query("SELECT id FROM docs WHERE id % 3 <> 0 UNION SELECT id FROM docs WHERE id % 2 = 0")
def insert_ignore(spark, d):
    rows = X.docs(spark, d).select("id")
    return corpus.insert_ignore(rows.where("id % 3 <> 0"), rows.where("id % 2 = 0"), "id")


@query("SELECT id, content FROM docs UNION ALL SELECT (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY item_id), text FROM benchmark")
def doc_insert(spark, d):
    new = X.load(spark, d, "benchmark").select("item_id", F.col("text").alias("content"))
    return corpus.insert(X.docs(spark, d).select("id", "content"), new, "item_id")


PATCHED = TOKENS.format("CASE WHEN id % 4 = 0 THEN left(content, 200) || ' patched' ELSE content END")


@query(f"SELECT id, CASE WHEN id % 4 = 0 AND id % 8 = 0 THEN NULL ELSE title END AS title, CASE WHEN id % 4 = 0 THEN left(content, 200) || ' patched' ELSE content END AS content, len(list_distinct({PATCHED})) AS textlen FROM docs")
def doc_update(spark, d):
    """Every fourth document gets a new content, every eighth loses its title."""
    rows = X.docs(spark, d).select("id", "title", "content", "textlen")
    patch = rows.where("id % 4 = 0").select("id", (F.col("id") % 8 == 0).alias("has_title"), F.lit(None).cast("string").alias("title"), F.lit(True).alias("has_content"), F.concat(F.left("content", F.lit(200)), F.lit(" patched")).alias("content"))
    return corpus.update(rows, patch).withColumn("textlen", F.col("textlen").cast("long"))


@query("SELECT id FROM docs WHERE id % 7 <> 0")
def doc_delete(spark, d):
    rows = X.docs(spark, d).select("id")
    return corpus.delete(rows, rows.where("id % 7 = 0"))


@query("SELECT id, CAST(NULL AS INT) AS textlen, CAST(NULL AS VARCHAR) AS doc_hash FROM docs")
def ensure_columns(spark, d):
    return corpus.ensure_columns(X.docs(spark, d).select("id"), {"id": "long", "textlen": "int", "doc_hash": "string"})


@query("SELECT greatest(coalesce((SELECT max(doc_id) FROM documents), 0), (SELECT max(item_id) FROM benchmark), 1) AS seat")
def sequence_seat(spark, d):
    return corpus.sequence_seat(X.load(spark, d, "documents").select(F.col("doc_id").alias("id")), X.load(spark, d, "benchmark").select(F.col("item_id").alias("id")))


@query("SELECT id, embedding IS NOT NULL AS copied, round(embedding[1], 6) AS first FROM corpus")
def embedding_copy(spark, d):
    side = X.vectors(spark, d).select("id", F.col("embedding").alias("side"))
    rows = X.docs(spark, d).select("id").withColumn("embedding", F.lit(None).cast("array<float>"))
    return rows.join(side, "id", "left").withColumn("embedding", F.coalesce("embedding", "side")).select("id", F.col("embedding").isNotNull().alias("copied"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


STATE = f"(SELECT docs.id, docs.content, CASE WHEN docs.id % 3 = 0 THEN an.tokens END AS fts, CASE WHEN docs.id % 3 = 0 OR docs.id % 5 = 0 THEN len(list_distinct(an.tokens)) END AS textlen, CASE WHEN docs.id % 2 = 0 THEN corpus.embedding END AS embedding, CASE WHEN docs.id % 2 = 1 THEN corpus.embedding END AS legacy, CASE WHEN docs.id % 6 = 0 THEN corpus.embedding[1:32] END AS embedding_hnsw FROM docs JOIN an USING (id) JOIN corpus USING (id))"
NEEDS = "(embedding_hnsw IS NULL OR fts IS NULL OR textlen IS NULL)"


def _state(spark, d):
    """Documents with parts of their derived columns missing."""
    from ..functions import text as T

    rows = X.docs(spark, d).select("id", "content").join(X.vectors(spark, d).withColumnRenamed("embedding", "e"), "id", "left")
    t = T.tokens(F.col("content"))
    rows = rows.withColumn("fts", F.when(F.col("id") % 3 == 0, t)).withColumn("textlen", F.when((F.col("id") % 3 == 0) | (F.col("id") % 5 == 0), T.text_length(t)))
    return rows.select("id", "content", "fts", "textlen", F.when(F.col("id") % 2 == 0, F.col("e")).alias("embedding"), F.when(F.col("id") % 2 == 1, F.col("e")).alias("legacy"), F.when(F.col("id") % 6 == 0, F.slice("e", 1, 32)).alias("embedding_hnsw"))


def _gaps(spark, d):
    """_state as to what is missing: a column is true or null. Neither contents nor vectors are shuffled by the join, only their marks."""
    from ..functions import text as T

    there = lambda c: F.when(c.isNotNull(), F.lit(True))
    t = F.when(F.col("content").isNotNull(), F.array(F.lit("")))  # words are null where the content is
    third, fifth = F.col("id") % 3 == 0, F.col("id") % 5 == 0
    docs = X.docs(spark, d).select("id", there(F.when(third, t)).alias("fts"), there(F.when(third | fifth, T.text_length(t))).alias("textlen"))
    vectors = X.vectors(spark, d).select("id", there(F.col("embedding")).alias("e"))
    return docs.join(vectors, "id", "left").select("id", "fts", "textlen", F.when(F.col("id") % 6 == 0, F.col("e")).alias("embedding_hnsw"))


@query(f"SELECT count(*) AS rows, count(*) FILTER (WHERE {NEEDS}) AS needs_backfill, count(*) AS snapshot_rows FROM {STATE}")
def backfill_count(spark, d):
    return backfill.count(_gaps(spark, d))


@query(f"SELECT id, fts IS NULL AS no_fts FROM {STATE} WHERE {NEEDS} AND id > 100 ORDER BY id LIMIT 50")
def backfill_chunk(spark, d):
    return backfill.chunk(_gaps(spark, d), 100, 50).select("id", F.col("fts").isNull().alias("no_fts"))


@query(f"""SELECT id, coalesce(textlen, len(list_distinct(tokens))) AS textlen, len(tokens) AS words, len(coalesce(embedding_hnsw, embedding[1:32], legacy[1:32])) AS dims, fts IS NULL OR textlen IS NULL AS queued
    FROM {STATE} JOIN (SELECT id, tokens FROM an) USING (id)""")
def backfill_process(spark, d):
    done = backfill.process(_state(spark, d), 64, 32)
    return done.select("id", F.col("textlen").cast("long").alias("textlen"), F.size("fts").cast("long").alias("words"), F.when(F.col("embedding_hnsw").isNotNull(), F.size("embedding_hnsw")).cast("long").alias("dims"), "queued")


@query(f"""SELECT id, coalesce(textlen, len(list_distinct(tokens))) AS textlen, len(tokens) AS words, len(coalesce(embedding_hnsw, embedding[1:32], legacy[1:32])) AS dims
    FROM {STATE} JOIN (SELECT id, tokens FROM an) USING (id)""")
def backfill_ranges(spark, d):
    """The same as one run over ranges of ids, each with its marker."""
    run = X.built(spark, d, "backfill", lambda folder: backfill.Run(spark, folder))
    done = run.go(_state(spark, d), lambda rows: backfill.process(rows, 64, 32))
    return done.select("id", F.col("textlen").cast("long").alias("textlen"), F.size("fts").cast("long").alias("words"), F.when(F.col("embedding_hnsw").isNotNull(), F.size("embedding_hnsw")).cast("long").alias("dims"))


@query(f"SELECT ceil(place / 128.0)::BIGINT AS chunk, id AS last_id, place AS processed, CASE WHEN place = total THEN 'completed' ELSE 'running' END AS state FROM (SELECT id, row_number() OVER (ORDER BY id) AS place, count(*) OVER () AS total FROM {STATE} WHERE {NEEDS}) WHERE place % 128 = 0 OR place = total")
def backfill_run(spark, d):
    return backfill.run(_gaps(spark, d), 128)


@query("SELECT id, round(CASE WHEN id % 10 = 0 THEN -embedding[1] ELSE embedding[1] END, 6) AS first FROM vec UNION ALL SELECT 1000000 + id, round(embedding[1], 6) FROM vec WHERE id % 50 = 0")
def upsert_embeddings(spark, d):
    """Side vectors by key: every tenth is replaced, every fiftieth comes in under a new key."""
    v = X.vectors(spark, d)
    changed = v.where("id % 10 = 0").select("id", F.transform("embedding", lambda x: -x).alias("embedding"))
    new = v.where("id % 50 = 0").select((F.lit(1_000_000) + F.col("id")).alias("id"), "embedding")
    return corpus.upsert(v, changed.unionByName(new), "id", keep=[]).select("id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query(f"SELECT id, round(legacy, 6) AS legacy FROM (SELECT id, {HASH} AS h FROM docs) LEFT JOIN (SELECT {HASH} AS h, min(embedding[1]) AS legacy FROM corpus WHERE embedding IS NOT NULL GROUP BY h) USING (h)")
def legacy_join(spark, d):
    """Documents with the vector that an older table has for their hash."""
    docs = X.docs(spark, d).select("id", "doc_hash")
    legacy = docs.join(X.vectors(spark, d), "id").groupBy("doc_hash").agg(F.min(F.get("embedding", F.lit(0)).cast("double")).alias("first")).select("doc_hash", F.array("first").alias("embedding"))
    return backfill.with_legacy(docs, legacy).select("id", F.round(F.get("legacy", F.lit(0)), 6).alias("legacy"))
