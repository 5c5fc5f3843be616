"""Evaluation: percentiles by rank, run summaries, neighbour overlap and vector comparisons, runs over an engine's answers."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from .selection import nearest_rank  # noqa: F401
from .tiles import neighbors  # noqa: F401


def p95_place(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n * 0.95))


def floor_place(ratio: float):
    return lambda n: F.least(n, F.floor(n * ratio) + 1)


def norm_summary(vectors: DataFrame) -> DataFrame:
    n = V.norm(F.col("embedding"))
    return vectors.select(n.alias("n")).agg(F.count("*").alias("vectors"), *[F.round(f("n"), 6).alias(k) for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("least", F.min), ("most", F.max))])


def jaccard(a: Column, b: Column) -> Column:
    """0 when both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Per query the share of the exact neighbours found."""
    hits = exact.select("query_id", "id").join(approximate.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 6).alias("recall"))


def compared(total: int, a: int, b: int, least: int, run: Callable[[], dict]) -> dict:
    """A comparison of two models, or why there are too few vectors for one. a, b: documents with a vector of each."""
    report = {"coverage": {"total": total, "a": a, "b": b}}
    if min(a, b) < least:
        return report | {"status": "insufficient", "reason": f"{least} vectors of each model are needed, there are {a} and {b}"}
    return report | {"status": "ok"} | run()


#: Strategies of answers that fell back to words or substrings.
FELL_BACK = ("bm25-only", "lexical-like")


def quality_run(search: Callable[[dict], dict], queries: list[tuple[str, int]], limit: int = 10, **request) -> dict:
    """Asks each query and holds the answer against the document it was made from: a row a query, and the summary (averages to 2 digits, rates to 4)."""
    rows = []
    for query, expected in queries:
        start = time.time()
        answer = search({"query": query, "limit": limit, **request})
        data = answer["data"][0] if answer["data"] else {"items": []}
        first = data["items"][0] if data["items"] else {}
        used = first.get("usedKeywords") or []
        rows.append({
            "query": query,
            "ok": answer["success"],
            "top1": first.get("id") == expected,
            "found": any(i["id"] == expected for i in data["items"]),
            "coverage": round(len(first.get("matchedKeywords") or []) / len(used), 3) if used else 0.0,
            "fellBack": data.get("strategy") in FELL_BACK,
            "tookMs": 1000 * (time.time() - start),
        })
    n = len(rows)
    rate = lambda key: round(sum(r[key] for r in rows) / n, 4) if n else 0.0
    mean = lambda key: round(sum(r[key] for r in rows) / n, 2) if n else 0.0
    took = sorted(r["tookMs"] for r in rows)
    p95 = took[max(0, int(n * 0.95) - 1)] if n else 0.0
    return {"rows": rows, "summary": {"queries": n, "successRate": rate("ok"), "top1Rate": rate("top1"), "foundRate": rate("found"), "fallbackRate": rate("fellBack"), "avgCoverage": mean("coverage"), "avgTookMs": mean("tookMs"), "p95TookMs": round(p95, 2)}}


def quality(found: DataFrame, queries: DataFrame, docs: DataFrame, snippet: int = 240) -> DataFrame:
    """A row for each query made from a document: its first answer (top1), the place of its own document among the answers, and how many of its words
    (to 3 digits) the first answer's title and snippet hold. Null and 0 where nothing was found.

    found: query_id, place, id, score; queries: query_id (that of the document), words; docs: id, title, content. Only snippets are joined.
    """
    shown = docs.select(F.col("id").alias("top1"), "title", F.left("content", F.lit(snippet)).alias("snippet"))
    asked = queries.select("query_id", "words")
    best = found.groupBy("query_id").agg(F.min(F.when(F.col("place") == 1, F.col("id"))).alias("top1"), F.min(F.when(F.col("id") == F.col("query_id"), F.col("place"))).alias("own_place"))
    rows = asked.join(best, "query_id", "left").join(shown, "top1", "left")
    covered = F.when(F.col("top1").isNotNull(), T.keyword_coverage(T.matched_keywords(F.col("words"), F.col("title"), F.coalesce("snippet", F.lit(""))), F.col("words"))).otherwise(0.0)
    return rows.select("query_id", "top1", "own_place", covered.alias("coverage"))


def quality_rates(rows: DataFrame) -> DataFrame:
    """The summary of quality rows: rates to 4 digits, the mean coverage to 2."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return rows.agg(
        F.count("*").alias("queries"),
        share(F.col("top1").isNotNull()).alias("answered_rate"),
        share(F.col("own_place") == 1).alias("top1_rate"),
        share(F.col("own_place").isNotNull()).alias("found_rate"),
        F.round(F.avg(F.coalesce(1 / F.col("own_place"), F.lit(0.0))), 4).alias("reciprocal_rank"),
        F.round(F.avg("coverage"), 2).alias("avg_coverage"),
    )


def throughput(run: Callable[[object], object], queries: list) -> dict:
    """Queries a second, one after the other."""
    start = time.time()
    for q in queries:
        run(q)
    took = time.time() - start
    return {"queries": len(queries), "seconds": round(took, 3), "qps": round(len(queries) / took, 2) if took else 0.0}
