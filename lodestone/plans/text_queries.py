"""Queries over texts and query strings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import segmentation, stemming
from ..functions import text as T
from ..functions import vector as V
from ..functions.analysers import Analyser
from . import inputs as X
from .registry import TOKENS, query

#: Queries that the analysis is held against.
SAMPLE = [
    "포켓몬 마스터",
    "포켓몬스터에서 가장 강한 포켓몬",
    "가장 좋은 프로그래밍 언어",
    "인공지능이 일자리에 미치는 영향",
    "대한민국을 빛낸 100명의 위인들",
    "ARM 아키텍처 설명",
    "김승민 래퍼",
    "무한도전 레전드 장면",
    "7대 불가사의",
    "포켓몬 배틀 메타",
    "ARM",
]


def _sql_list(items) -> str:
    return "(" + ", ".join(f"'{x}'" for x in items) + ")"


INPUT = f"(SELECT * FROM (VALUES {', '.join(f'({k}, ' + chr(39) + q + chr(39) + ')' for k, q in enumerate(SAMPLE))}) AS t(n, q) UNION ALL SELECT 1000 + item_id, text FROM benchmark)"
WORDS = TOKENS.format("trim(q)")
SQL_TERMS = f"(SELECT n, q, list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: list_position(w, p[1]) = p[2]), lambda p: p[1]) AS terms FROM (SELECT n, q, list_transform({WORDS}, lambda t: coalesce(nullif(regexp_replace(t, '{T.SUFFIX}', ''), ''), t)) AS w FROM {INPUT}))"
#: All sample strings lie in the basic plane, where UTF-16 units are characters.
SQL_LONG = "(len(terms) >= 4 OR length(trim(lower(q))) >= 16)"
SQL_SIGNALS = f"""(SELECT n, q, keyword, place, round(w * CASE WHEN long_ AND length(keyword) >= 3 THEN 1.1::DOUBLE ELSE 1.0 END * CASE WHEN keyword IN {_sql_list(T.DOMAIN_ANCHORS)} THEN 1.35::DOUBLE ELSE 1.0 END
    * CASE WHEN {' OR '.join(f"starts_with(keyword, '{r}')" for r in T.BROAD_ROOTS)} THEN 0.3::DOUBLE ELSE 1.0 END * CASE WHEN keyword IN {_sql_list(T.GENERIC_INTENTS)} THEN 0.45::DOUBLE ELSE 1.0 END, 3) AS weight
    FROM (SELECT n, q, keyword, place, {SQL_LONG} AS long_, round(0.7::DOUBLE * least(length(keyword) / 8.0::DOUBLE, 1.0) + 0.3::DOUBLE * greatest(0.0, 1 - 0.08::DOUBLE * place), 3) AS w
      FROM (SELECT n, q, terms, unnest(terms) AS keyword, unnest(range(0, len(terms))) AS place FROM {SQL_TERMS})))"""
SQL_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY n ORDER BY weight DESC, place) AS r FROM {SQL_SIGNALS})"


def _input(spark, d):
    given = spark.createDataFrame(list(enumerate(SAMPLE)), "n long, q string")
    return given.unionByName(X.load(spark, d, "benchmark").select((F.lit(1000) + F.col("item_id")).alias("n"), F.col("text").alias("q")))


def _terms(spark, d):
    return _input(spark, d).withColumn("terms", T.query_terms(F.col("q")))


def _long():
    return (F.size("terms") >= 4) | (T.utf16_length(F.trim(F.lower("q"))) >= 16)


def _signals(spark, d):
    rows = _terms(spark, d).select("n", "q", _long().alias("long"), F.posexplode("terms").alias("place", "keyword"))
    scored = rows.withColumn("weight", T.keyword_signal(F.col("keyword"), F.col("place"), F.col("long")))
    return scored.withColumn("r", F.row_number().over(W.partitionBy("n").orderBy(F.desc("weight"), "place")))


@query(f"SELECT n, array_to_string(terms, '|') AS terms FROM {SQL_TERMS}")
def query_terms(spark, d):
    return _terms(spark, d).select("n", F.array_join("terms", "|").alias("terms"))


@query(f"SELECT n, keyword, weight, r::INT AS r FROM {SQL_RANKED} WHERE r <= 8")
def keyword_signals(spark, d):
    return _signals(spark, d).where("r <= 8").select("n", "keyword", "weight", "r")


@query(f"""SELECT n, {SQL_LONG} AS long_query, least(10 * CASE WHEN len(terms) <= 2 AND length(trim(lower(q))) <= 12 THEN 12 WHEN {SQL_LONG} THEN 6 ELSE 9 END, 120) AS pool,
    coalesce((SELECT string_agg(keyword, ' ' ORDER BY r) FROM {SQL_RANKED} k WHERE k.n = t.n AND r <= CASE WHEN {SQL_LONG} THEN 3 ELSE 4 END), '') AS bm25_text FROM {SQL_TERMS} t""")
def query_profile(spark, d):
    t = _terms(spark, d).select("n", "q", "terms", _long().alias("long_query"))
    short = (F.size("terms") <= 2) & (T.utf16_length(F.trim(F.lower("q"))) <= 12)
    times = F.when(short, T.POOL_SHORT).when(F.col("long_query"), T.POOL_LONG).otherwise(T.POOL_DEFAULT)
    first = _signals(spark, d).where(F.col("r") <= F.when(F.col("long"), T.TERMS_LONG).otherwise(T.TERMS_DEFAULT))
    words = first.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("r", "keyword"))).alias("k"))  # four at most
    text = F.array_join(F.transform("k", lambda x: x["keyword"]), " ")
    return t.join(words, "n", "left").select("n", "long_query", F.least(T.POOL_WINDOW * times, F.lit(T.POOL_MOST)).alias("pool"), F.coalesce(text, F.lit("")).alias("bm25_text"))


def _sql_clean(column: str) -> str:
    out = column
    for pattern, to in T.SNIPPET_RULES:
        out = f"regexp_replace({out}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return f"coalesce(nullif(trim({out}), ''), '{T.EMPTY_SNIPPET}')"


@query(f"SELECT 'page' AS kind, page_id AS id, {_sql_clean('html')} AS snippet FROM pages UNION ALL SELECT 'document', doc_id, {_sql_clean('text')} FROM documents")
def snippet_clean(spark, d):
    pages = X.load(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), T.snippet_clean(F.col("html")).alias("snippet"))
    return pages.unionByName(X.load(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), T.snippet_clean(F.col("text")).alias("snippet")))


PEOPLE = "CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN ' , ' ELSE source || ', ' || lang || ' ,,' || source || ',x' END"


@query(f"SELECT doc_id AS id, array_to_string(CASE WHEN len(coalesce(t, [])) > 0 THEN t ELSE ['Corpus'] END, '|') AS tags FROM (SELECT doc_id, list_filter(list_transform(string_split({PEOPLE}, ','), lambda x: trim(x)), lambda x: length(x) > 0)[1:3] AS t FROM documents)")
def tags_split(spark, d):
    return X.load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_join(T.tags(F.expr(PEOPLE)), "|").alias("tags"))


@query("SELECT id, array_to_string(list_filter(['the', 'of', 'entre'], lambda k: contains(lower(coalesce(title, '') || ' ' || left(content, 240)), k)), '|') AS matched FROM docs")
def matched_keywords(spark, d):
    return _matched(spark, d).select("id", F.array_join("matched", "|").alias("matched"))


def _matched(spark, d):
    used = F.array(*[F.lit(x) for x in ("the", "of", "entre")])
    return X.docs(spark, d).select("id", T.matched_keywords(used, F.col("title"), F.left("content", F.lit(240))).alias("matched"))


@query("SELECT id, round(len(list_filter(['the', 'of', 'entre'], lambda k: contains(lower(coalesce(title, '') || ' ' || left(content, 240)), k))) / 3.0::DOUBLE, 3) AS coverage FROM docs")
def keyword_coverage(spark, d):
    used = F.array(*[F.lit(x) for x in ("the", "of", "entre")])
    return _matched(spark, d).select("id", T.keyword_coverage(F.col("matched"), used).alias("coverage"))


@query("SELECT doc_id AS id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 4000) AS text FROM documents")
def embed_text_normalize(spark, d):
    return X.load(spark, d, "documents").select(F.col("doc_id").alias("id"), T.embed_text(F.col("text")).alias("text"))


TITLE = "coalesce(nullif(trim(regexp_replace(title, '\\s+', ' ', 'g')), ''), '문서')"


@query(f"SELECT id, {TITLE} AS title FROM docs WHERE title IS NOT NULL")
def eval_titles(spark, d):
    clean = F.coalesce(F.nullif(F.trim(F.regexp_replace("title", r"\s+", " ")), F.lit("")), F.lit("문서"))
    return X.docs(spark, d).where("title IS NOT NULL").select("id", clean.alias("title"))


# The parts of synthetic queries.
BRIDGES = ["중심으로", "관점에서", "기준으로", "위주로"]
PREFIXES = ["핵심 개념과 배경을", "주요 특징과 차이점을", "역사적 맥락과 현재 의미를", "실전에서 중요한 포인트를", "비교 관점에서 핵심만"]
ENDINGS = ["정리해줘", "설명해줘", "요약해줘", "알려줘"]


def _sql_pick(items, seed: str) -> str:
    return f"[{', '.join(repr(x) for x in items)}][1 + ('0x' || left(md5('{seed}:' || id), 6))::INT % {len(items)}]"


@query(f"SELECT id, concat_ws(' ', {TITLE}, {_sql_pick(BRIDGES, 'a')}, {_sql_pick(PREFIXES, 'b')}, {_sql_pick(ENDINGS, 'c')}) AS q FROM docs WHERE title IS NOT NULL")
def eval_queries(spark, d):
    """A part of each list, chosen by a hash of the seed and the id."""
    pick = lambda items, seed: F.element_at(F.array(*[F.lit(x) for x in items]), (1 + F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id")).cast("binary")), F.lit(6)), 16, 10).cast("int") % len(items)).cast("int"))
    return eval_titles(spark, d).select("id", F.concat_ws(" ", "title", pick(BRIDGES, "a"), pick(PREFIXES, "b"), pick(ENDINGS, "c")).alias("q"))


@query()
def stemmed_words(spark, d):
    """The stems of all documents' words, with their positions."""
    docs = X.load(spark, d, "documents")
    return stemming.stems(docs, T.tokens(F.col("text")), "doc_id").select("id", "stem", F.array_join("positions", ",").alias("positions"), "tf")


@query()
def segmented_words(spark, d):
    """The pieces of all documents' words with their positions, by the lexicon learned from all of them."""
    cut = Analyser("korean", X.lexicon(spark, d), segmentation.LETTERS, stop=())
    return cut.positions(X.load(spark, d, "documents"), "doc_id", "text").select("id", "term", F.array_join("positions", ",").alias("positions"), "tf")


PHRASE = "of the"


@query("SELECT id, n FROM (SELECT id, len(list_filter(range(1, len(tokens)), lambda i: tokens[i] = 'of' AND tokens[i + 1] = 'the')) AS n FROM an) WHERE n > 0")
def phrase_matches(spark, d):
    """The documents with the phrase, and how often they have it."""
    return Analyser("simple").phrase(X.load(spark, d, "documents"), PHRASE, "doc_id", "text")


@query()
def latent_vectors(spark, d):
    """A vector of each document, learned from the terms of all."""
    return X.latent(spark, d).vectors().select("id", V.joined(F.transform("embedding", F.abs), 3).alias("v"))
