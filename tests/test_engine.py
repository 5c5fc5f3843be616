from __future__ import annotations

import pytest

from lodestone import engine as engine_module
from lodestone.engine import Engine, Invalid, ManagedTable, explanation, parse_request
from lodestone.operators import evaluate
from lodestone.plans import inputs
from lodestone.sources.ingest import scan

from .conftest import SMALL


@pytest.mark.parametrize(
    "body, error",
    [
        (None, "query must be provided as string"),
        ({"query": "  "}, "query is required"),
        ({"query": "x" * 201}, "query length must be 200 or fewer"),
        ({"query": "x", "embeddingModel": "bad"}, "embeddingModel must be qwen3"),
        ({"query": "x", "offset": -1}, "offset must be 0 or greater"),
        ({"query": "x", "limit": 101}, "limit must be between 1 and 100"),
        ({"query": "x", "mode": "bad"}, "mode must be one of none, hnsw, ivf"),
        ({"query": "x", "hybridRatio": 101}, "hybridRatio must be between 0 and 100"),
    ],
)
def test_validation(body, error):
    with pytest.raises(Invalid, match=error):
        parse_request(body)


def test_defaults():
    r = parse_request({"query": " ARM ", "limit": "7.9"})
    assert (r.query, r.offset, r.limit, r.mode, r.bm25, r.ratio) == ("ARM", 0, 7, "none", True, 50)


def made(spark, stored: bool, embed=None, **more) -> Engine:
    docs = inputs.docs(spark, SMALL)
    vectors = docs.select("id").join(inputs.vectors(spark, SMALL), "id", "left")
    seven = inputs.query_vector(spark, SMALL).first().q
    e = Engine(spark, embed=embed or (lambda q: None if q == "entre" else seven))
    e.register(ManagedTable("documents", "english", **({"docs": docs, "vectors": vectors, "scope": inputs.scope(spark, SMALL), "is_default": True, "index": inputs.index(spark, SMALL) if stored else None} | more)))
    return e


@pytest.fixture(scope="module", params=[True, False], ids=["stored", "analysed"])
def engine(spark, request):
    return made(spark, request.param)


def first(answer):
    assert answer["success"]
    return answer["data"][0]


def test_search(engine):
    out = engine.search({"query": "the of", "limit": 5})
    assert out["success"] and out["meta"]["total"] > 5 and len(out["data"][0]["items"]) == 5
    assert all(i["score"] in (0.984, 0.891, 0.723) for i in out["data"][0]["items"])
    assert out["data"][0]["queryExplanation"].startswith("Planner selected ") and out["data"][0]["executionPlan"]["Total Cost"] > 0


def test_stored_and_analysed_agree(spark):
    a, b = made(spark, True), made(spark, False)
    for body in ({"query": "the of", "limit": 20}, {"query": "entre para", "limit": 20}):
        x, y = a.search(body), b.search(body)
        assert [(i["id"], i["score"]) for i in first(x)["items"]] == [(i["id"], i["score"]) for i in first(y)["items"]] and x["meta"]["total"] == y["meta"]["total"]
    for body in ({"query": "the of and", "limit": 20, "hybridRatio": 30}, {"query": "entre", "limit": 20}, {"query": "the of", "bm25Enabled": False, "mode": "ivf"}):
        x, y = first(a.search_hybrid(body)), first(b.search_hybrid(body))
        assert x["strategy"] == y["strategy"] and [(i["id"], i["score"]) for i in x["items"]] == [(i["id"], i["score"]) for i in y["items"]]


def test_hybrid_and_fallback(engine):
    out = engine.search_hybrid({"query": "the of and", "mode": "hnsw", "limit": 5, "hybridRatio": 70})
    assert out["data"][0]["strategy"] == "hybrid" and out["data"][0]["items"][0]["id"] == 7
    words = first(engine.search_hybrid({"query": "entre", "limit": 5}))
    assert words["strategy"] == "bm25-only" and words["reason"] == "query-embedding-vector-missing" and words["items"]
    like = first(engine.search_hybrid({"query": "entre", "limit": 5, "bm25Enabled": False}))
    assert like["strategy"] == "lexical-like" and {i["score"] for i in like["items"]} <= {0.984, 0.891, 0.723} and "Fell back to lexical LIKE search" in like["queryExplanation"]
    assert first(engine.search_hybrid({"query": "the of", "limit": 5, "bm25Enabled": False}))["strategy"] == "vector"
    assert first(engine.search_hybrid({"query": "the", "offset": 120}))["reason"] == "ann-candidates-empty"
    assert first(engine.search_hybrid({"query": "?!"})) == {"items": [], "strategy": "empty", "keywordSignals": []}
    assert engine.search({"query": "x", "tableName": "none"})["error"] == "Managed table none is not ready for search"
    assert engine.health() == {"status": "ok"}


def test_modes_use_their_indexes(spark):
    """With all indexes the engine answers as without, as far as pools of 0.9 recall go; words and substrings exactly."""
    from lodestone.plans import inputs

    plain = made(spark, True)
    own = made(spark, True, substrings=inputs.substrings(spark, SMALL), graphs=inputs.graphs(spark, SMALL), codes=inputs.codes(spark, SMALL))
    for mode in ("hnsw", "ivf"):
        body = {"query": "the of and", "hybridRatio": 60, "limit": 10, "mode": mode}
        a, b = plain.search_hybrid(body)["data"][0], own.search_hybrid(body)["data"][0]
        assert a["strategy"] == b["strategy"] == "hybrid"
        assert len({i["id"] for i in a["items"]} & {i["id"] for i in b["items"]}) >= 7
    for q in ("the", "the of", "nowhere at all"):
        a, b = plain.search({"query": q, "limit": 7, "offset": 2}), own.search({"query": q, "limit": 7, "offset": 2})
        assert [(i["id"], i["score"]) for i in a["data"][0]["items"]] == [(i["id"], i["score"]) for i in b["data"][0]["items"]] and a["meta"]["total"] == b["meta"]["total"]


def test_reasons(spark, monkeypatch):
    none = made(spark, True, vectors=inputs.vectors(spark, SMALL).where("false"))
    assert first(none.search_hybrid({"query": "the"}))["reason"] == "embedding-store-empty:documents"

    def raises(q):
        raise RuntimeError("worker is gone")

    assert first(made(spark, True, raises).search_hybrid({"query": "the"}))["reason"] == "worker is gone"
    weak = made(spark, True, lambda q: [-x for x in inputs.query_vector(spark, SMALL).first().q])
    monkeypatch.setattr(engine_module.search, "WEAK_SCORE", 0.99)
    assert first(weak.search_hybrid({"query": "the of and to", "hybridRatio": 100}))["reason"] == "ann-signal-weak"
    wrong = made(spark, True, lambda q: ["x"])
    assert first(wrong.search_hybrid({"query": "the"}))["reason"].startswith("ann-query-failed:")
    off = first(wrong.search_hybrid({"query": "the", "bm25Enabled": False}))
    assert off["items"] == [] and off["executionPlan"]["Node Type"] == "Unavailable" and "Root cause" in off["queryExplanation"]
    gone = made(spark, True, raises, docs=spark.range(0).selectExpr("id"))
    assert first(gone.search_hybrid({"query": "the"}))["strategy"] == "unavailable"


def test_plan_switch(spark, monkeypatch):
    monkeypatch.setenv("SEARCH_INCLUDE_EXPLAIN", "false")
    out = first(made(spark, True).search({"query": "the of", "limit": 2}))
    assert out["executionPlan"] == {} and out["queryExplanation"] == "Execution plan omitted because SEARCH_INCLUDE_EXPLAIN is disabled."


def test_quality_run(spark):
    engine = made(spark, True)
    ran = evaluate.quality_run(engine.search_hybrid, [("the of and", 7), ("entre", -1)], 5, hybridRatio=70)
    s = ran["summary"]
    assert (s["queries"], s["successRate"], s["top1Rate"], s["fallbackRate"]) == (2, 1.0, 0.5, 0.5) and s["avgTookMs"] > 0
    assert evaluate.quality_run(engine.search, [])["summary"]["queries"] == 0
    assert evaluate.compared(10, 5, 0, 3, dict)["status"] == "insufficient" and evaluate.compared(10, 5, 4, 3, lambda: {"x": 1})["x"] == 1
    assert evaluate.throughput(len, ["a", "b"])["queries"] == 2


def test_explanation(spark):
    assert explanation(inputs.docs(spark, SMALL)).startswith("Planner selected ")


def test_scan(spark, tmp_path):
    spark.createDataFrame([("a", "x"), (None, ""), ("b", None)], "title string, text string").write.parquet(f"{tmp_path}/t")
    assert [tuple(r) for r in scan(spark, f"{tmp_path}/t").collect()] == [("a", "x", None, None)]
    assert scan(spark, f"{tmp_path}/t", 0).count() == 0
