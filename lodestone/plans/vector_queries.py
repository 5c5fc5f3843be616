"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import ann, evaluate, search, tiles
from . import inputs as X
from .registry import query

joined = V.joined


Q = "(SELECT embedding AS q FROM vec WHERE id = 7)"


def _top(distance: str, keep: str = "TRUE") -> str:
    return f"SELECT id, round(d, 6) AS distance FROM (SELECT vec.id, {distance} AS d FROM vec, {Q}) WHERE {keep} ORDER BY d, id LIMIT 10"


@query(_top("1 - list_cosine_similarity(embedding, q)"))
def vector_topk_cosine(spark, d):
    return search.vector_topk(X.vectors(spark, d), X.query_vector(spark, d), 10)


@query(_top("-list_inner_product(embedding, q)"))
def vector_topk_ip(spark, d):
    return search.vector_topk(X.vectors(spark, d), X.query_vector(spark, d), 10, V.negative_inner_product)


@query(_top("list_distance(embedding, q)"))
def vector_topk_l2(spark, d):
    return search.vector_topk(X.vectors(spark, d), X.query_vector(spark, d), 10, V.l2_distance)


@query("SELECT count(*) AS vectors, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, round(min(n), 6) AS least, round(max(n), 6) AS most FROM (SELECT sqrt(list_inner_product(embedding, embedding)) AS n FROM vec)")
def norm_summary(spark, d):
    return evaluate.norm_summary(X.vectors(spark, d))


@query("SELECT id, array_to_string(list_transform(embedding, lambda x: printf('%.6f', x / greatest(sqrt(list_inner_product(embedding, embedding)), 1e-12))), ',') AS v FROM vec")
def vector_normalize(spark, d):
    return X.vectors(spark, d).select("id", joined(V.normalize(F.col("embedding"))).alias("v"))


@query("SELECT id, array_to_string(list_transform(embedding[1:32], lambda x: printf('%.6f', x)), ',') AS v FROM vec")
def vector_truncate(spark, d):
    return X.vectors(spark, d).select("id", joined(V.truncate(F.col("embedding"), 32)).alias("v"))


@query("SELECT id, array_to_string(list_transform(embedding, lambda x, i: CASE WHEN i = 1 AND id % 3 = 0 OR i = 2 AND id % 5 = 0 THEN '0.000000' ELSE printf('%.6f', x) END), ',') AS v, id % 3 = 0 OR id % 5 = 0 AS changed FROM vec")
def vector_sanitize(spark, d):
    dirty = F.transform("embedding", lambda x, i: F.when((i == 0) & (F.col("id") % 3 == 0), float("nan")).when((i == 1) & (F.col("id") % 5 == 0), float("inf")).otherwise(x.cast("double")))
    clean, changed = V.sanitize(F.col("dirty"))
    return X.vectors(spark, d).select("id", dirty.alias("dirty")).select("id", joined(clean).alias("v"), changed.alias("changed"))


@query("SELECT id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.8f', x)), ',') || ']' AS literal FROM vec")
def vector_format(spark, d):
    return X.vectors(spark, d).select("id", V.render(F.col("embedding")).alias("literal"))


@query("SELECT id, array_to_string(list_transform(embedding, lambda x: printf('%.8f', printf('%.8f', x)::DOUBLE)), ',') AS v, 0::BIGINT AS bad_size FROM vec")
def vector_parse(spark, d):
    literal = V.render(F.col("embedding"))
    with_noise = F.concat(F.lit(" "), F.regexp_replace(literal, r"\]$", ",NaN]"))
    return X.vectors(spark, d).select("id", joined(V.parse(with_noise), 8).alias("v"), F.size(V.parse(F.concat(literal, F.lit(";")))).cast("long").alias("bad_size"))


@query("SELECT id, round(coalesce(list_cosine_similarity(embedding[1:32], e2[1:32]), 0), 6) AS cosine FROM (SELECT a.id, a.embedding, b.embedding AS e2 FROM vec a JOIN vec b ON b.id = a.id + 1)")
def aligned_cosine(spark, d):
    v = X.vectors(spark, d)
    pairs = v.join(v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("next")), "id")
    short = V.truncate(F.col("embedding"), 32)
    return pairs.select("id", F.round(F.coalesce(V.cosine(short, F.slice("next", F.lit(1), F.size(short))), F.lit(0.0)), 6).alias("cosine"))


#: The queries of a search: every row whose id is divisible by 20, against all rows.
QUERY_ROWS = "id % 20 = 0"
NEIGHBORS = f"(SELECT q.id AS query_id, v.id, round(1 - list_cosine_similarity(v.embedding{{0}}, q.embedding{{0}}), 9) AS d, row_number() OVER (PARTITION BY q.id ORDER BY round(1 - list_cosine_similarity(v.embedding{{0}}, q.embedding{{0}}), 9), v.id) AS rank FROM vec v JOIN vec q ON q.id <> v.id WHERE q.{QUERY_ROWS})"


@query(f"SELECT query_id, id, rank::INT AS rank, round(d, 6) AS distance FROM {NEIGHBORS.format('')} WHERE rank <= 10")
def knn_neighbors(spark, d):
    v = X.vectors(spark, d)
    return evaluate.neighbors(v, v.where(QUERY_ROWS), 10)


JACCARD = f"""SELECT query_id, round(sum(CASE WHEN a AND b THEN 1.0 ELSE 0 END) / count(*), 6) AS jaccard FROM (
    SELECT coalesce(x.query_id, y.query_id) AS query_id, x.id IS NOT NULL AS a, y.id IS NOT NULL AS b
    FROM (SELECT * FROM {NEIGHBORS.format('')} WHERE rank <= 10) x FULL JOIN (SELECT * FROM {NEIGHBORS.format('[1:32]')} WHERE rank <= 10) y ON x.query_id = y.query_id AND x.id = y.id) GROUP BY query_id"""


@query(JACCARD)
def neighbor_jaccard(spark, d):
    v = X.vectors(spark, d)
    short = v.select("id", V.truncate(F.col("embedding"), 32).alias("embedding"))
    sets = lambda t, c: evaluate.neighbors(t, t.where(QUERY_ROWS), 10).groupBy("query_id").agg(F.collect_set("id").alias(c))  # noqa: E731  10 ids each
    return sets(v, "a").join(sets(short, "b"), "query_id", "full_outer").select("query_id", F.round(evaluate.jaccard(F.coalesce("a", F.array().cast("array<bigint>")), F.coalesce("b", F.array().cast("array<bigint>"))), 6).alias("jaccard"))


@query("SELECT (SELECT count(*) FROM documents) AS total, count(*) AS with_vector, count(*) FILTER (WHERE len(embedding) >= 32) AS with_prefix FROM embeddings JOIN documents ON doc_id = vec_id")
def embedding_coverage(spark, d):
    docs, v = X.load(spark, d, "documents").select("doc_id"), X.vectors(spark, d)
    both = docs.join(v, F.col("doc_id") == F.col("id"), "left")
    return both.agg(F.count("*").alias("total"), F.count("id").alias("with_vector"), F.count_if(F.size("embedding") >= 32).alias("with_prefix"))


@query("SELECT id, round(list_cosine_similarity(embedding, embedding), 6) AS self FROM corpus WHERE embedding IS NOT NULL ORDER BY md5('17:' || id), id LIMIT 20")
def paired_sample(spark, d):
    both = X.docs(spark, d).select("id").join(X.vectors(spark, d), "id")
    return both.orderBy(F.md5(F.concat(F.lit("17:"), F.col("id")).cast("binary")), "id").limit(20).select("id", F.round(V.cosine(F.col("embedding"), F.col("embedding")), 6).alias("self"))


@query("SELECT id, array_to_string(CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN list_transform(embedding[1:32], lambda x: printf('%.6f', -x)) ELSE list_transform(embedding[1:32], lambda x: printf('%.6f', x)) END, ',') AS v FROM vec")
def derive_hnsw(spark, d):
    explicit = F.when(F.col("id") % 4 == 1, F.transform(V.truncate(F.col("embedding"), 32), lambda x: -x.cast("double")))
    embedding = F.when(F.col("id") % 4 != 0, F.transform("embedding", lambda x: x.cast("double")))
    return X.vectors(spark, d).select("id", joined(V.derive_hnsw(explicit, embedding, 64, 32)).alias("v"))


@query("SELECT id, array_to_string(CASE WHEN id % 3 = 1 THEN list_transform(embedding[1:32], lambda x: printf('%.6f', x)) WHEN id % 3 = 2 THEN list_transform(embedding[1:32], lambda x: printf('%.6f', x)) END, ',') AS v FROM vec")
def backfill_derive(spark, d):
    """Every third source has a wrong size, every third only the legacy column."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    own = F.when(F.col("id") % 3 == 0, F.slice(e, 1, 48)).when(F.col("id") % 3 == 1, e)
    return X.vectors(spark, d).select("id", joined(V.backfill_hnsw(own, F.when(F.col("id") % 3 == 2, F.slice(e, 1, 32)), 64, 32)).alias("v"))


@query("SELECT doc_id IS NOT NULL AS available FROM (SELECT max(doc_id) AS doc_id FROM documents JOIN embeddings ON vec_id = doc_id)")
def embeddings_available(spark, d):
    found = X.load(spark, d, "documents").join(X.vectors(spark, d), F.col("doc_id") == F.col("id"), "left_semi").limit(1)
    return found.agg((F.count("*") > 0).alias("available"))


def _probed(spark, d):
    return X.lists(spark, d).search(X.vectors(spark, d).where(QUERY_ROWS), 10, X.PROBES)


@query()
def ann_ivf(spark, d):
    return _probed(spark, d)


@query()
def ann_recall(spark, d):
    v = X.vectors(spark, d)
    return evaluate.recall(evaluate.neighbors(v, v.where(QUERY_ROWS), 10), _probed(spark, d))


@query()
def ann_graph(spark, d):
    return X.graphs(spark, d).search(X.vectors(spark, d).where(QUERY_ROWS), 10)


@query()
def ann_graph_recall(spark, d):
    """Of each query the share of its exact neighbours found, and of all vectors those compared."""
    v = X.vectors(spark, d)
    asked = v.where(QUERY_ROWS)
    found = X.graphs(spark, d).found(asked, 10, 80)
    recall = evaluate.recall(evaluate.neighbors(v, asked, 10), tiles.merged(found, 10))
    return recall.join(X.graphs(spark, d).compared(asked, 10), "query_id")


@query()
def ann_compressed(spark, d):
    return X.codes(spark, d).search(X.vectors(spark, d).where(QUERY_ROWS), 10)


@query()
def ann_compressed_recall(spark, d):
    """Of each query the share of its exact neighbours found, and the bytes read as a share of all vectors'."""
    v = X.vectors(spark, d)
    asked, found = v.where(QUERY_ROWS), ann_compressed(spark, d)
    return evaluate.recall(evaluate.neighbors(v, asked, 10), found).join(X.codes(spark, d).share(found), "query_id")


@query("SELECT id, array_to_string(list_transform(range(1, 9), lambda i: printf('%.6f', (embedding[i] * (id % 2) + embedding[i + 8] + embedding[i + 16] * 1) / (2 + id % 2))), ',') AS v FROM vec")
def masked_mean_pool(spark, d):
    """Three states of eight numbers each; the first one's mask is the id's last bit."""
    states = F.array(*[F.slice("embedding", 1 + 8 * k, 8) for k in range(3)])
    mask = F.array((F.col("id") % 2).cast("int"), F.lit(1), F.lit(1))
    return X.vectors(spark, d).select("id", joined(V.masked_mean(states, mask)).alias("v"))
