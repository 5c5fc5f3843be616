"""Search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.analysers import Analyser
from ..operators import evaluate, search
from . import inputs as X
from .registry import TOKENS, query

LIST = "['the', 'entre', 'para']"
BM25 = f"""(SELECT id, round(sum(ln(1 + (n - tfdoc + 0.5::DOUBLE) / (tfdoc + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len_ / avglen))), 6) AS score FROM
  (SELECT id, token, len_, count(*) AS tf FROM (SELECT id, len(list_distinct(tokens)) AS len_, unnest(tokens) AS token FROM an) WHERE token IN ('the', 'entre', 'para') GROUP BY ALL)
  JOIN (SELECT token, count(*) AS tfdoc FROM (SELECT unnest(list_distinct(tokens)) AS token FROM scope) GROUP BY token) USING (token),
  (SELECT count(*) AS n, avg(CASE WHEN table_name = 'documents' THEN len(list_distinct(tokens)) END) AS avglen FROM scope) GROUP BY id)"""
WORDS = "'the of'"
LIKE = "the of"


def _scores(spark, d):
    return X.index(spark, d).score(X.TOKENS, "documents")


@query(f"SELECT id, score FROM {BM25}")
def bm25_score(spark, d):
    return _scores(spark, d)


@query(f"SELECT id, score FROM {BM25}")
def bm25_score_unindexed(spark, d):
    """Without a stored index: the documents are analysed."""
    return search.bm25_score(X.analysed(spark, d), X.scope(spark, d), X.TOKENS)


@query(f"SELECT id, score FROM {BM25} ORDER BY score DESC, id DESC LIMIT 10")
def bm25_topk(spark, d):
    return X.index(spark, d).top(X.TOKENS, "documents", 10)


@query()
def bm25_blocks(spark, d):
    """Blocks of the query's lists, and how many of them the best ten need."""
    return X.index(spark, d).skipped(X.TOKENS, "documents", 10)


ASKED = f"(SELECT id AS query_id, list_distinct({TOKENS.format('title')}) AS words FROM docs WHERE id % 20 = 0)"
MANY = f"""(SELECT query_id, place, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS place FROM (
  SELECT query_id, id, round(sum(ln(1 + (n - tfdoc + 0.5::DOUBLE) / (tfdoc + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len_ / avglen))), 6) AS score
  FROM (SELECT query_id, unnest(words) AS token FROM {ASKED})
  JOIN (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(tokens) AS token FROM an) GROUP BY id, token) USING (token) JOIN (SELECT id, len(list_distinct(tokens)) AS len_ FROM an) USING (id)
  JOIN (SELECT token, count(*) AS tfdoc FROM (SELECT unnest(list_distinct(tokens)) AS token FROM scope) GROUP BY token) USING (token),
  (SELECT count(*) AS n, avg(CASE WHEN table_name = 'documents' THEN len(list_distinct(tokens)) END) AS avglen FROM scope) GROUP BY query_id, id)) WHERE place <= 10)"""
QUALITY = f"""(SELECT a.query_id, t.id AS top1, o.place AS own_place, CASE WHEN t.id IS NULL OR len(words) = 0 THEN 0 ELSE round(len(list_filter(words, lambda k: contains(lower(coalesce(d.title, '') || ' ' || left(d.content, 240)), k))) / len(words)::DOUBLE, 3) END::DOUBLE AS coverage
  FROM {ASKED} a LEFT JOIN many t ON t.query_id = a.query_id AND t.place = 1 LEFT JOIN many o ON o.query_id = a.query_id AND o.id = a.query_id LEFT JOIN docs d ON d.id = t.id)"""


def _asked(spark, d):
    """A query of each twentieth document: the words of its title."""
    return X.docs(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.array_distinct(T.tokens(F.col("title"))).alias("words"))


def _many(spark, d):
    return X.index(spark, d).top_many(_asked(spark, d), "documents", 10)


@query(f"SELECT query_id, place, id, score FROM {MANY}")
def bm25_topk_many(spark, d):
    """The best ten of every twentieth document's title, all in one pass over the stored lists."""
    return _many(spark, d)


@query(f", many AS {MANY} SELECT query_id, top1, own_place, coverage FROM {QUALITY}")
def search_quality(spark, d):
    """Whether a search for a document's title finds it, at which place, and how much of the title the first answer shows."""
    return evaluate.quality(_many(spark, d), _asked(spark, d), X.docs(spark, d))


@query(f""", many AS {MANY} SELECT count(*) AS queries, round(avg((top1 IS NOT NULL)::INT), 4) AS answered_rate, round(avg(CASE WHEN own_place = 1 THEN 1 ELSE 0 END), 4) AS top1_rate,
    round(avg((own_place IS NOT NULL)::INT), 4) AS found_rate, round(avg(coalesce(1.0::DOUBLE / own_place, 0)), 4) AS reciprocal_rank, round(avg(coverage), 2) AS avg_coverage FROM {QUALITY}""")
def search_quality_summary(spark, d):
    return evaluate.quality_rates(search_quality(spark, d))


STEMMED = "ered, ononst"


@query()
def stemmed_search(spark, d):
    """The best ten by the stems of the query's words: other forms of a word are found too."""
    return X.stem_index(spark, d).top(Analyser("english").query(STEMMED), "documents", 10)


MATCH = f"""(SELECT *, lower(coalesce(title, '')) LIKE '%{LIKE}%' AS like_title, lower(content) LIKE '%{LIKE}%' AS like_content, list_has_all(tokens, ['the', 'of']) AS words,
    list_has_all(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(title, '')), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda t: length(t) > 0), ['the', 'of']) AS title_words
    FROM docs JOIN (SELECT id, tokens FROM an) USING (id))"""
FOUND = f"(SELECT * FROM {MATCH} WHERE like_title OR words OR like_content)"


@query("SELECT id FROM docs WHERE lower(coalesce(title, '')) LIKE '%the%' OR lower(content) LIKE '%entre%'")
def lexical_like(spark, d):
    docs, sub = X.docs(spark, d), X.substrings(spark, d)
    return sub.like(docs, "title", search.like_pattern(" The ")).unionByName(sub.like(docs, "content", search.like_pattern("entre"))).distinct()


@query("SELECT id FROM an WHERE list_has_all(tokens, ['the', 'of'])")
def fts_match_all(spark, d):
    return X.index(spark, d).matching(["the", "of"], "documents")


@query(f"SELECT id, coalesce(title, 'Untitled Document') AS title, left(content, 240) AS snippet, namespace, score, round(1 - score, 4) AS distance, round(score * 100, 1) AS match_rate FROM (SELECT *, (CASE WHEN like_title THEN 0.984 WHEN words THEN 0.891 ELSE 0.723 END)::DOUBLE AS score FROM {FOUND}) ORDER BY score DESC, id DESC LIMIT 10 OFFSET 5")
def lexical_search(spark, d):
    return search.lexical_indexed(X.docs(spark, d), LIKE, 10, 5, X.index(spark, d), "documents", X.substrings(spark, d))


@query(f"SELECT count(*) AS total FROM {FOUND}")
def lexical_search_count(spark, d):
    return search.matches_indexed(X.docs(spark, d), LIKE, X.index(spark, d), "documents", X.substrings(spark, d)).agg(F.count("*").alias("total"))


@query(f"""SELECT id, title, bm25_score, greatest(least(1.0::DOUBLE, greatest(0.0::DOUBLE, round(bm25_score / (1 + bm25_score), 3))), (CASE WHEN title_words THEN 0.98 WHEN like_title THEN 0.89 WHEN like_content THEN 0.72 ELSE 0.0 END)::DOUBLE) AS score, title_words, like_title, like_content
    FROM (SELECT f.*, coalesce(b.score, 0) AS bm25_score FROM {FOUND} f LEFT JOIN {BM25} b USING (id)) ORDER BY title_words DESC, bm25_score DESC, like_title DESC, like_content DESC, id DESC LIMIT 20""")
def lexical_fallback(spark, d):
    return search.lexical_fallback_indexed(X.docs(spark, d), _scores(spark, d), LIKE, 20, 0, X.index(spark, d), "documents", X.substrings(spark, d))


def _sql_hybrid(distance: str, vector: str, ratio: float, limit: int = 10) -> str:
    unit = lambda x: f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, round({x}, 3)))"
    return f"""SELECT id, round(d, 6) AS vector_distance, round(s, 6) AS bm25_score, {unit(f"{unit('v')} * ws + {unit('s / (1 + s)')} * wk")} AS score, round({unit(f"{unit('v')} * ws + {unit('s / (1 + s)')} * wk")} * 100, 1) AS match_rate FROM (
      SELECT *, {vector} AS v, {ratio}::DOUBLE AS ws, {round(1 - ratio, 3)}::DOUBLE AS wk FROM (SELECT n.id, n.d, coalesce(b.score, 0) AS s FROM
        (SELECT corpus.id, round({distance}, 9) AS d FROM corpus, (SELECT embedding AS q FROM vec WHERE id = 7) WHERE embedding IS NOT NULL ORDER BY {distance}, id LIMIT 120) n LEFT JOIN {BM25} b USING (id)))
      ORDER BY round(ws * v + wk * (s / (1 + s)), 9) DESC, id DESC LIMIT {limit}"""


def _embedded(spark, d):
    return X.docs(spark, d).select("id").join(X.vectors(spark, d), "id", "left")


def _with_documents(spark, d):
    """The vectors of documents."""
    return X.vectors(spark, d).join(X.load(spark, d, "documents").select(F.col("doc_id").alias("id")), "id", "left_semi")


@query(_sql_hybrid("1 - list_cosine_similarity(embedding, q)", "1 - d / 2", 0.53))
def hybrid_search(spark, d):
    return search.hybrid_stored(_with_documents(spark, d), X.query_vector(spark, d), X.index(spark, d), "documents", X.TOKENS, 120, 53, 10)


@query(_sql_hybrid("-list_inner_product(embedding, q)", "(1 - d) / 2", 0.7))
def hybrid_search_ip(spark, d):
    return search.hybrid_stored(_with_documents(spark, d), X.query_vector(spark, d), X.index(spark, d), "documents", X.TOKENS, 120, 70, 10, mode="ivf")


@query("SELECT least(120, count(embedding)) AS total FROM corpus")
def hybrid_count(spark, d):
    return _embedded(spark, d).agg(F.least(F.lit(120).cast("long"), F.count("embedding")).alias("total"))


@query(f"SELECT max(score) AS top_score, count(*) AS n, count(*) > 0 AND (max(score) < 0.34 OR count(*) < 3) AS fall_back FROM ({_sql_hybrid('1 - list_cosine_similarity(embedding, q)', '1 - d / 2', 0.53)})")
def weak_ann_decision(spark, d):
    found = hybrid_search(spark, d)
    return search.weak(found, 10, T.is_long(["the", "entre", "para", "of"], "the entre para of"))
