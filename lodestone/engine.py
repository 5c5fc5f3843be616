"""The engine: request validation, the hybrid search cascade and its envelope, over tables registered in a session.

A hybrid request goes to the nearest vectors first. Where there are none, the query can't be embedded, the answer is
empty or, for long queries, weak, it goes to words (bm25 on) or to substrings (bm25 off); where that fails too, the
answer is empty and says why. Tables with a stored index read their token rows from it; others are analysed.
"""

from __future__ import annotations

import math
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import index, search
from .operators.compressed import Compressed
from .operators.graph import Graphs
from .operators.stored import Index
from .operators.substrings import Substrings

MODES = ("none", "hnsw", "ivf")
MODEL = "qwen3"


class Invalid(ValueError):
    """A request that can't be served; the message is the answer's error."""


@dataclass
class Request:
    query: str
    offset: int = 0
    limit: int = 20
    table_name: str | None = None
    mode: str = "none"
    bm25: bool = True
    ratio: int = 50


def whole(value, default: int) -> int:
    if isinstance(value, str) and value.strip():
        try:
            value = float(value)
        except ValueError:
            return default
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        return default
    return math.trunc(value)


def parse_request(body, hybrid: bool = True) -> Request:
    """Checks in this order: query, model, offset, limit, mode, ratio."""
    if not isinstance(body, dict) or not isinstance(body.get("query"), str):
        raise Invalid("query must be provided as string")
    q = body["query"].strip()
    if not q:
        raise Invalid("query is required")
    if T.units(q) > 200:
        raise Invalid("query length must be 200 or fewer")
    r = Request(q, whole(body.get("offset"), 0), whole(body.get("limit"), 20), (body.get("tableName") or "").strip() or None)
    if body.get("embeddingModel", MODEL) != MODEL:
        raise Invalid(f"embeddingModel must be {MODEL}")
    if r.offset < 0:
        raise Invalid("offset must be 0 or greater")
    if not 1 <= r.limit <= 100:
        raise Invalid("limit must be between 1 and 100")
    if hybrid:
        r.mode, r.ratio = body.get("mode", "none"), whole(body.get("hybridRatio"), 50)
        r.bm25 = body["bm25Enabled"] if isinstance(body.get("bm25Enabled"), bool) else True
        if r.mode not in MODES:
            raise Invalid("mode must be one of none, hnsw, ivf")
        if not 0 <= r.ratio <= 100:
            raise Invalid("hybridRatio must be between 0 and 100")
    return r


@dataclass
class ManagedTable:
    """A searchable table: id, title, content, namespace, contributors and, for vectors, id and embedding; scope is the language's analysed tables."""

    name: str
    language: str
    docs: DataFrame
    vectors: DataFrame | None = None
    scope: DataFrame | None = None
    k1: float = 1.2
    b: float = 0.75
    is_default: bool = False
    eligible: bool = True
    index: Index | None = None
    substrings: Substrings | None = None
    graphs: Graphs | None = None
    codes: Compressed | None = None


@dataclass
class Engine:
    """embed turns a query into its vector; without one, or when it fails, words alone are searched."""

    spark: SparkSession
    embed: Callable[[str], list[float]] | None = None
    tables: dict[str, ManagedTable] = field(default_factory=dict)

    def register(self, table: ManagedTable) -> None:
        if table.is_default:
            for t in self.tables.values():
                t.is_default = False
        self.tables[table.name] = table

    def resolve(self, name: str | None) -> ManagedTable:
        if name is not None:
            t = self.tables.get(name)
            if t is None or not t.eligible:
                raise Invalid(f"Managed table {name} is not ready for search")
            return t
        ready = sorted((t for t in self.tables.values() if t.eligible), key=lambda t: (not t.is_default, t.name))
        if not ready:
            raise Invalid("No managed table is ready for search")
        return ready[0]

    def analysed(self, t: ManagedTable) -> DataFrame:
        return index.analysed(t.docs, t.name, fts_col="fts" if "fts" in t.docs.columns else None)

    def scores(self, t: ManagedTable, words: list[str]) -> DataFrame:
        if t.index is not None:
            return t.index.score(words, t.name, t.k1, t.b)
        own = self.analysed(t)
        return search.bm25_score(own, t.scope if t.scope is not None else own, words, t.k1, t.b)

    def matches(self, t: ManagedTable, query: str) -> DataFrame:
        if t.index is not None and t.substrings is not None:
            return search.matches_indexed(t.docs, query, t.index, t.name, t.substrings)
        return search.matches(t.docs, query) if t.index is None else search.matches_stored(t.docs, query, t.index, t.name)

    def search(self, body) -> dict:
        """Substrings and words, ranked by kind of match."""
        return self._answer(lambda r, t: self._lexical(r, t), body, hybrid=False)

    def search_hybrid(self, body) -> dict:
        """Nearest vectors ranked with words; the word ladder where there is no vector, no result or too weak a one."""
        return self._answer(lambda r, t: self._hybrid(r, t), body, hybrid=True)

    def query(self, body) -> dict:
        r = body if isinstance(body, dict) else {}
        hybrid = r.get("mode", "none") != "none" or r.get("bm25Enabled", True) or r.get("hybridRatio", 50) != 50 or r.get("offset", 0) > 0
        return self.search_hybrid(body) if hybrid else self.search(body)

    def health(self) -> dict:
        """Whether the session answers and the embedder, where it tells, is ready."""
        ready = getattr(self.embed, "ready", None)
        up = self.spark.range(1).count() == 1
        return {"status": "ok" if up else "error"} | ({} if ready is None else {"embedder": ready() if callable(ready) else bool(ready)})

    def _answer(self, run, body, hybrid: bool) -> dict:
        start = time.time()
        try:
            r = parse_request(body, hybrid)
            t = self.resolve(r.table_name)
        except Invalid as e:
            return {"success": False, "data": [], "error": str(e), "meta": {"tookMs": int(1000 * (time.time() - start))}}
        try:
            data = run(r, t)
        except Exception as e:  # whatever storage or planning raised: the answer is empty and says so
            data = unavailable(e)
        meta = {"total": data.pop("total"), "offset": r.offset, "limit": r.limit, "tookMs": int(1000 * (time.time() - start)), "embeddingModelUsed": MODEL, "tableNameUsed": t.name, "languageUsed": t.language}
        return {"success": True, "data": [data], "meta": meta}

    def _planned(self, df: DataFrame, note: str = "") -> dict:
        """The plan and its sentence, unless SEARCH_INCLUDE_EXPLAIN is 'false'."""
        if os.environ.get("SEARCH_INCLUDE_EXPLAIN") == "false":
            return {"executionPlan": {}, "queryExplanation": f"Execution plan omitted because SEARCH_INCLUDE_EXPLAIN is disabled.{note}"}
        found = plan_of(df)
        return {"executionPlan": found, "queryExplanation": f"{sentence(found)}{note}"}

    def _items(self, ranked: DataFrame, t: ManagedTable, keywords: list[str]) -> list[dict]:
        """At most 100 rows, with what the reader sees of each document."""
        rows = [r.asDict() for r in ranked.collect()]
        ids = [r["id"] for r in rows]
        used = F.array(*[F.lit(k) for k in keywords]) if keywords else F.array().cast("array<string>")
        snippet = F.left("content", F.lit(search.SNIPPET))
        shown = t.docs.where(F.col("id").isin(ids)).select("id", F.coalesce("title", F.lit("Untitled Document")).alias("title"), snippet.alias("snippet"), F.coalesce("namespace", F.lit(t.name)).alias("category"), T.tags(F.col("contributors")).alias("tags"), T.matched_keywords(used, F.col("title"), snippet).alias("matchedKeywords"))
        by_id = {r.id: r.asDict() for r in shown.collect()} if ids else {}
        return [by_id[r["id"]] | {"score": r["score"], "distance": round(1 - r["score"], 4), "matchRate": round(100 * r["score"], 1), "usedKeywords": keywords} for r in rows]

    def _lexical(self, r: Request, t: ManagedTable) -> dict:
        words = [k for k, _ in T.signals_of(r.query)]
        if t.index is not None and t.substrings is not None:
            ranked = search.lexical_indexed(t.docs, r.query, r.limit, r.offset, t.index, t.name, t.substrings)
        else:
            ranked = search.lexical(t.docs, r.query, r.limit, r.offset, t.index, t.name)
        return {"items": self._items(ranked, t, words), "total": self.matches(t, r.query).count(), "strategy": "lexical"} | self._planned(ranked)

    def _fallback(self, r: Request, t: ManagedTable, why: str) -> dict:
        """By words where bm25 is on, else by substrings."""
        if not r.bm25:
            out = self._lexical(r, t)
            return out | {"strategy": "lexical-like", "reason": why, "queryExplanation": f"{out['queryExplanation']} Fell back to lexical LIKE search because {why}."}
        words = [k for k, _ in T.signals_of(r.query)]
        if t.index is not None and t.substrings is not None:
            ranked = search.lexical_fallback_indexed(t.docs, self.scores(t, words), r.query, r.limit, r.offset, t.index, t.name, t.substrings)
        else:
            ranked = search.lexical_fallback(t.docs, self.scores(t, words), r.query, r.limit, r.offset, t.index, t.name)
        found = {"items": self._items(ranked, t, words), "total": self.matches(t, r.query).count()}
        return found | {"strategy": "bm25-only", "reason": why} | self._planned(ranked, f" Fell back to word search because {why}.")

    def _vector(self, r: Request) -> tuple[list[float] | None, str]:
        """The query's vector, or why there is none."""
        if not self.embed:
            return None, "query-embedding-unavailable"
        try:
            vector = self.embed(r.query)
        except Exception as e:  # an embedder is the caller's code: any failure leaves words
            return None, str(e) or type(e).__name__
        return (list(map(float, vector)), "") if vector is not None and len(vector) else (None, "query-embedding-vector-missing")

    def _hybrid(self, r: Request, t: ManagedTable) -> dict:
        signals = T.signals_of(r.query)
        words = [k for k, _ in signals]
        if not words:
            return {"items": [], "total": 0, "strategy": "empty", "keywordSignals": []}
        try:
            embedded = None if t.vectors is None else t.vectors.where("embedding IS NOT NULL")
            if embedded is None or embedded.isEmpty():
                return self._fallback(r, t, f"embedding-store-empty:{t.name}")
            vector, why = self._vector(r)
            if vector is None:
                return self._fallback(r, t, why)
            q = self.spark.createDataFrame([(vector,)], "q array<double>")
            pool, mode = T.pool_of(r.query, r.limit, r.offset), "ivf" if r.mode == "ivf" else "hnsw"
            if (near := t.codes if mode == "ivf" else t.graphs) is not None:  # the pool by the mode's index, its distances from the vectors
                asked = self.spark.createDataFrame([(-1, vector)], "id long, embedding array<double>")
                embedded = embedded.where(F.col("id").isin([x.id for x in near.search(asked, pool).collect()]))
            if t.index is not None:
                ranked = search.hybrid_stored(embedded, q, t.index, t.name, words, pool, r.ratio, r.limit, r.offset, mode, r.bm25, t.k1, t.b)
            else:
                ranked = search.hybrid(embedded, q, self.scores(t, words) if r.bm25 else None, pool, r.ratio, r.limit, r.offset, mode, r.bm25)
            items = self._items(ranked, t, words)
            total = min(pool, t.vectors.where("embedding IS NOT NULL").count())
        except Exception as e:
            if not r.bm25:
                raise
            return self._fallback(r, t, f"ann-query-failed:{e}")
        long = T.is_long(T.terms_of(r.query), r.query)
        if not items:
            return self._fallback(r, t, "ann-candidates-empty")
        if r.bm25 and long and (items[0]["score"] < search.WEAK_SCORE or len(items) < min(r.limit, 3)):
            return self._fallback(r, t, "ann-signal-weak")
        return {"items": items, "total": total, "strategy": "hybrid" if r.bm25 else "vector", "keywordSignals": signals} | self._planned(ranked)


def unavailable(error: Exception) -> dict:
    reason = str(error).splitlines()[0] if str(error) else type(error).__name__
    return {"items": [], "total": 0, "strategy": "unavailable", "reason": reason, "executionPlan": {"Node Type": "Unavailable", "Reason": reason}, "queryExplanation": f"The query failed, so no search results were returned. Root cause: {reason}. Check the tables and retry."}


def plan_of(df: DataFrame) -> dict:
    """The root node, the first relation read, and the optimizer's estimates of bytes (as cost) and rows."""
    execution = df._jdf.queryExecution()
    lines = [x.strip(" +-*():") for x in execution.executedPlan().toString().splitlines()]
    scans = [x.split("[")[0].strip() for x in lines if "Scan" in x]
    root = lines[1 if lines[0].startswith("AdaptiveSparkPlan") and len(lines) > 1 else 0].split("(")[0].strip()
    stats = execution.optimizedPlan().stats()
    out = {"Node Type": root, "Relation Name": scans[0] if scans else "no relation", "Total Cost": float(str(stats.sizeInBytes()))}
    return out | ({"Plan Rows": int(str(stats.rowCount().get()))} if stats.rowCount().isDefined() else {})


def sentence(plan: dict) -> str:
    cost, rows = plan.get("Total Cost"), plan.get("Plan Rows")
    return f"Planner selected {plan.get('Node Type', 'Unknown Node')} on {plan.get('Relation Name', 'unknown relation')}{'' if cost is None else f' with total cost {cost:.2f}'}{'' if rows is None else f' and estimated rows {rows}'}."


def explanation(df: DataFrame) -> str:
    """What the planner chose, in a sentence."""
    return sentence(plan_of(df))
