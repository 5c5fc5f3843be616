"""Search: ranking of words, vectors and both, over plain scans that Catalyst prunes, with top-k instead of full sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from . import index as I

WEAK_SCORE = 0.34
SNIPPET = 240


def bm25_term(tf: Column, df: Column, length: Column, n: Column, avglen: Column, k1: float, b: float) -> Column:
    k1, b = round(k1, 6), round(b, 6)
    idf = F.ln(1 + (n - df + 0.5) / (df + 0.5))
    return idf * (tf * round(k1 + 1, 6)) / (tf + k1 * (1 - b + b * F.coalesce(length, F.lit(0)) / F.nullif(avglen, F.lit(0.0))))


def bm25_score(docs: DataFrame, scope: DataFrame, query: list[str], k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
    """id and score of the documents that have a query token. docs, scope: analysed tables; scope is the language's.

    Only the query's tokens are exploded and shuffled; their document frequencies are one row each.
    """
    name = docs.select("table_name").limit(1)
    wanted = lambda d: d.select(*I.KEY, "len", F.explode(F.filter("tokens", lambda t: t.isin(query))).alias("token"))
    tf = wanted(docs).groupBy(*I.KEY, "len", "token").agg(F.count("*").alias("tf"))
    df = scope.select(F.explode(F.filter(F.array_distinct("tokens"), lambda t: t.isin(query))).alias("token")).groupBy("token").agg(F.count("*").alias("tfdoc"))
    stats = I.lengths(scope)
    stats = stats.join(F.broadcast(name.withColumn("own", F.lit(True))), "table_name", "left").agg(F.sum("recordcount").alias("n"), F.max(F.when(F.col("own"), F.col("avglen"))).alias("avglen"))
    joined = tf.join(F.broadcast(df), "token").crossJoin(F.broadcast(stats))  # at most a row per query token, and one row
    term = bm25_term(F.col("tf"), F.col("tfdoc"), F.col("len"), F.col("n"), F.col("avglen"), k1, b)
    return joined.groupBy("id").agg(F.round(F.coalesce(F.sum(term), F.lit(0.0)), digits).alias("score"))


def top(df: DataFrame, k: int, *order: Column, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(k)


def vector_topk(vectors: DataFrame, query: DataFrame, k: int, distance=V.cosine_distance, digits: int = 6) -> DataFrame:
    """id, distance of the k nearest. vectors: id, embedding; query: one row with the column q."""
    d = vectors.where("embedding IS NOT NULL").crossJoin(F.broadcast(query)).select("id", distance(F.col("embedding"), F.col("q")).alias("distance"))
    return top(d.where("distance IS NOT NULL"), k, F.asc("distance"), F.asc("id")).withColumn("distance", F.round("distance", digits))


def unit(x: Column, digits: int = 3) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(x, digits)))


def squash(s: Column) -> Column:
    return s / (1 + s)


def weights(ratio: int, bm25: bool = True) -> tuple[float, float]:
    semantic = round(ratio / 100, 3) if bm25 else 1.0
    return semantic, round(1 - semantic, 3) if bm25 else 0.0


def vector_score(d: Column, mode: str) -> Column:
    return (1 - d) / 2 if mode == "ivf" else 1 - d / 2


def ranked_pool(near: DataFrame, scores: DataFrame | None, ratio: int, limit: int, offset: int = 0, mode: str = "hnsw", bm25: bool = True) -> DataFrame:
    """The pool ranked by the weighted sum of both scores. near: id, distance, at most a pool of rows; scores: id, score, or None where words don't count."""
    ws, wk = weights(ratio, bm25)
    if scores is None:
        both = near.withColumn("bm25", F.lit(0.0))
    else:
        both = scores.withColumnRenamed("score", "bm25").join(F.broadcast(near), "id", "right").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    vec, lex = vector_score(F.col("distance"), mode), squash(F.col("bm25"))
    ranked = top(both.withColumn("rank_key", F.round(ws * vec + wk * lex, 9)), limit, F.desc("rank_key"), F.desc("id"), offset=offset)
    score = unit(unit(vec) * ws + unit(lex) * wk)
    return ranked.select("id", F.round("distance", 6).alias("vector_distance"), F.round("bm25", 6).alias("bm25_score"), score.alias("score")).withColumn("match_rate", F.round(F.col("score") * 100, 1))


def nearest_pool(vectors: DataFrame, query: DataFrame, pool: int, mode: str = "hnsw") -> DataFrame:
    return vector_topk(vectors, query, pool, V.negative_inner_product if mode == "ivf" else V.cosine_distance, digits=9)


def hybrid(vectors: DataFrame, query: DataFrame, scores: DataFrame | None, pool: int, ratio: int, limit: int, offset: int = 0, mode: str = "hnsw", bm25: bool = True) -> DataFrame:
    """The pool of nearest vectors ranked by the weighted sum of both scores. vectors: id, embedding; scores: id, score."""
    return ranked_pool(nearest_pool(vectors, query, pool, mode), scores, ratio, limit, offset, mode, bm25)


def hybrid_stored(vectors: DataFrame, query: DataFrame, index, table: str, words: list[str], pool: int, ratio: int, limit: int, offset: int = 0, mode: str = "hnsw", bm25: bool = True, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """hybrid over a stored index: the pool (120 rows at most) is fetched first, and only its documents' token rows are read."""
    near = nearest_pool(vectors, query, min(pool, T.POOL_MOST), mode)
    rows = near.collect()
    local = near.sparkSession.createDataFrame(rows, near.schema)
    scores = index.score(words, table, k1, b, ids=[r.id for r in rows]) if bm25 and words and rows else None
    return ranked_pool(local, scores, ratio, limit, offset, mode, bm25)


def like_pattern(q: str, escape: bool = False) -> str:
    q = q.strip().lower()
    if escape:
        for c in "\\%_":
            q = q.replace(c, "\\" + c)
    return f"%{q}%"


def match_all(tokens: Column, query: list[str]) -> Column:
    """Every query token is in the document; an empty query matches nothing."""
    if not query:
        return F.lit(False)
    return F.size(F.array_except(F.array(*[F.lit(t) for t in dict.fromkeys(query)]), tokens)) == 0


def matches(docs: DataFrame, q: str, analysed=T.tokens) -> DataFrame:
    """The documents that match as substring or by all words, with each kind of match. docs: id, title, content."""
    p, words = like_pattern(q), T.terms_of(q)
    found = docs.select("*", F.lower(F.coalesce("title", F.lit(""))).like(p).alias("like_title"), F.lower("content").like(p).alias("like_content"), match_all(analysed(F.col("content")), words).alias("words"), match_all(analysed(F.coalesce("title", F.lit(""))), words).alias("title_words"))
    return found.where("like_title OR words OR like_content")


def matches_stored(docs: DataFrame, q: str, index, table: str) -> DataFrame:
    """matches, with word matches from a stored index: id and each kind of match. Only substrings are looked for in the contents, and no content is shuffled."""
    p, words = like_pattern(q), T.terms_of(q)
    flags = docs.select("id", F.lower(F.coalesce("title", F.lit(""))).like(p).alias("like_title"), F.lower("content").like(p).alias("like_content"), match_all(T.tokens(F.coalesce("title", F.lit(""))), words).alias("title_words"))
    flags = flags.where("like_title OR like_content OR title_words")
    both = flags.join(index.matching(words, table).withColumn("words", F.lit(True)), "id", "full_outer")
    both = both.select("id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("like_title", "like_content", "title_words", "words")])
    return both.where("like_title OR words OR like_content")


def lexical(docs: DataFrame, q: str, limit: int, offset: int = 0, index=None, table: str = "documents") -> DataFrame:
    """Documents by kind of match. With a stored index only the top rows' documents are looked up."""
    found = matches(docs, q) if index is None else matches_stored(docs, q, index, table)
    score = F.when(F.col("like_title"), 0.984).when(F.col("words"), 0.891).otherwise(0.723).cast("double")
    ranked = top(found.withColumn("score", score), limit, F.desc("score"), F.desc("id"), offset=offset)
    if index is not None:
        ranked = docs.join(F.broadcast(ranked.select("id", "score")), "id").orderBy(F.desc("score"), F.desc("id"))  # limit rows
    return ranked.select("id", F.coalesce("title", F.lit("Untitled Document")).alias("title"), F.left("content", F.lit(SNIPPET)).alias("snippet"), "namespace", "score", F.round(1 - F.col("score"), 4).alias("distance"), F.round(F.col("score") * 100, 1).alias("match_rate"))


def lexical_indexed(docs: DataFrame, q: str, limit: int, offset: int, index, table: str, substrings) -> DataFrame:
    """lexical over stored lists of words and trigrams. Title and word matches come first; contents are only looked for as substrings
    if those are too few, and then only the candidates' are fetched. The best rows are few and put together here."""
    p, n = like_pattern(q), limit + offset
    kinds = [(0.984, lambda: substrings.like(docs, "title", p)), (0.891, lambda: index.matching(T.terms_of(q), table)), (0.723, lambda: substrings.like(docs, "content", p))]
    best: dict[int, float] = {}
    for score, find in kinds:
        for r in find().orderBy(F.desc("id")).limit(n).collect():  # n of each kind hold the best n of all
            best.setdefault(r.id, score)
        if len(best) >= n:
            break
    ranked = sorted(best.items(), key=lambda x: (-x[1], -x[0]))[offset:n]
    rows = docs.sparkSession.createDataFrame(ranked, "id long, score double")
    shown = docs.where(F.col("id").isin([i for i, _ in ranked])).join(F.broadcast(rows), "id").orderBy(F.desc("score"), F.desc("id"))  # limit rows
    return shown.select("id", F.coalesce("title", F.lit("Untitled Document")).alias("title"), F.left("content", F.lit(SNIPPET)).alias("snippet"), "namespace", "score", F.round(1 - F.col("score"), 4).alias("distance"), F.round(F.col("score") * 100, 1).alias("match_rate"))


def matches_indexed(docs: DataFrame, q: str, index, table: str, substrings) -> DataFrame:
    """id of all documents that match as substring or by all words; contents of candidates only are read."""
    p = like_pattern(q)
    sets = [substrings.like(docs, "title", p), index.matching(T.terms_of(q), table), substrings.like(docs, "content", p)]
    return sets[0].unionByName(sets[1]).unionByName(sets[2]).distinct()


def lexical_fallback(docs: DataFrame, scores: DataFrame, q: str, limit: int, offset: int = 0, index=None, table: str = "documents") -> DataFrame:
    """Ranked by words in the title, word score, substring in the title, in the content, id."""
    kinds = ("title_words", "like_title", "like_content")
    found = (matches(docs, q).select("id", *kinds) if index is None else matches_stored(docs, q, index, table)).join(scores.withColumnRenamed("score", "bm25"), "id", "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    return _shown(docs, found, limit, offset)


#: Candidates whose contents are tested first.
TESTED = 512


def lexical_fallback_indexed(docs: DataFrame, scores: DataFrame, q: str, limit: int, offset: int, index, table: str, substrings) -> DataFrame:
    """lexical_fallback over stored lists of words and trigrams: candidates are ranked by what the lists know, and the first TESTED of them are
    tested for the substring. If the rows asked for aren't certain then (too few pass, or ties go on beyond them), all candidates are."""
    p, words = like_pattern(q), T.terms_of(q)
    candidates = substrings.candidates("content", p)
    if candidates is None:  # a pattern without a trigram
        return lexical_fallback(docs, scores, q, limit, offset, index, table)
    flags = ["like_title", "words", "title_words", "maybe"]
    sets = dict(zip(flags, (substrings.like(docs, "title", p), index.matching(words, table), substrings.title_words(words), candidates)))
    found = None
    for name, ids in sets.items():
        one = ids.select("id", *[F.lit(f == name).alias(f) for f in flags])
        found = one if found is None else found.unionByName(one)
    found = found.groupBy("id").agg(*[F.max(f).alias(f) for f in flags]).where("like_title OR words OR maybe")
    found = found.join(scores.withColumnRenamed("score", "bm25"), "id", "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    known = ("title_words", "bm25", "like_title")
    first = found.orderBy(*[F.desc(c) for c in known]).limit(TESTED + 1).collect()
    n, whole = limit + offset, first
    if len(first) > TESTED:  # those that tie with the first one left out aren't all here
        whole = [r for r in first if tuple(r[c] for c in known) != tuple(first[-1][c] for c in known)]
    spark, kinds = docs.sparkSession, ("title_words", "like_title", "like_content")
    own = docs.where(F.col("id").isin([r.id for r in whole])).where(F.lower("content").like(p)).select("id")
    holds = {r.id for r in own.collect()} if whole else set()
    rows = [(r.id, r.bm25, r.title_words, r.like_title, r.id in holds) for r in whole if r.like_title or r.words or r.id in holds]
    if len(rows) >= n or len(first) <= TESTED:
        ranked = spark.createDataFrame(rows, "id long, bm25 double, title_words boolean, like_title boolean, like_content boolean")
    else:
        ranked = found.join(substrings.like(docs, "content", p).select("id", F.lit(True).alias("like_content")), "id", "left").withColumn("like_content", F.coalesce("like_content", F.lit(False)))
        ranked = ranked.where("like_title OR words OR like_content").select("id", "bm25", *kinds)
    return _shown(docs, ranked, limit, offset)


def _shown(docs: DataFrame, found: DataFrame, limit: int, offset: int) -> DataFrame:
    """The best rows of found (id, bm25, title_words, like_title, like_content) with their titles and scores."""
    kinds = ("title_words", "like_title", "like_content")
    order = [F.desc(c) for c in ("title_words", "bm25", "like_title", "like_content", "id")]
    ranked = top(found, limit, *order, offset=offset)
    boost = F.when(F.col("title_words"), 0.98).when(F.col("like_title"), 0.89).when(F.col("like_content"), 0.72).otherwise(0.0)
    ranked = docs.select("id", "title").join(F.broadcast(ranked.select("id", "bm25", *kinds)), "id").orderBy(*order)  # limit rows
    return ranked.select("id", "title", F.col("bm25").alias("bm25_score"), F.greatest(unit(squash(F.col("bm25"))), boost).alias("score"), *kinds)


def weak(rows: DataFrame, limit: int, long_query: bool, bm25: bool = True) -> DataFrame:
    """Whether results (column score) are too weak to stand."""
    few = min(limit, 3)
    return rows.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("top_score"), F.count("*").alias("n")).select("top_score", "n", (F.lit(bool(bm25 and long_query)) & (F.col("n") > 0) & ((F.col("top_score") < WEAK_SCORE) | (F.col("n") < few))).alias("fall_back"))
