from __future__ import annotations

import pytest

from lodestone import admin as A
from lodestone.admin import Admin, Refused
from lodestone.sinks import parse_events


@pytest.mark.parametrize(
    "parse, body, error",
    [
        (A.parse_registration, {}, "tableName must be provided as string"),
        (A.parse_registration, {"tableName": 3}, "tableName must be provided as string"),
        (A.parse_settings, {}, "At least one of k1 or b must be provided"),
        (A.parse_settings, [], "Request body must be an object"),
        (A.parse_settings, {"k1": 0}, "k1 must be greater than 0"),
        (A.parse_settings, {"b": 1.5}, "b must be between 0 and 1"),
        (A.parse_document, {"content": None}, "content must be a string"),
        (A.parse_document, {"title": 3}, "title must be a string or null"),
        (A.parse_document, {"embedding": [1, "x"]}, "embedding must be an array of finite numbers or null"),
        (A.parse_id, "0", "id must be a positive integer"),
        (A.parse_id, "1.5", "id must be a positive integer"),
        (A.parse_chunk, "0", "chunkSize must be a positive integer"),
        (A.identifier, "a; drop", "Unsafe SQL identifier"),
    ],
)
def test_refused(parse, body, error):
    with pytest.raises(Refused, match=error):
        parse(body)


def test_parsers():
    assert A.parse_settings({"k1": "1.5", "b": 0.6}) == {"k1": 1.5, "b": 0.6} and A.parse_chunk(None) == 100 and A.parse_chunk("5000") == 1000 and A.parse_id("7") == 7
    assert A.literal("it's \\ x") == "'it\\'s \\\\ x'" and A.quoted("a_b") == "`a_b`" and A.text_config("Korean ") == "korean" and A.text_config("klingon") == "simple"


def test_unique_suffix():
    from lodestone.operators.corpus import unique_suffix

    assert unique_suffix("Old English!", set()) == "old_english"
    second = unique_suffix("Old English!", {"old_english"})
    assert second.startswith("old_english_") and len(second) == 18
    assert unique_suffix("Old English!", {"old_english", second}) == f"{second}_2" and unique_suffix("!", set()) == "lang"


def test_registration_merge():
    before = {"language": "korean", "idColumn": "doc", "docHashColumn": "hash", "description": "old", "embeddingDim": 8, "isDefault": True}
    out = A.merged({"tableName": "t", "titleColumn": "name"}, before, "english")
    assert (out["language"], out["idColumn"], out["docHashColumn"], out["titleColumn"], out["description"], out["embeddingDim"], out["makeDefault"]) == ("korean", "doc", "hash", "name", "old", 8, True)
    cleared = A.merged(A.parse_registration({"tableName": "t", "docHashColumn": None, "description": None}), before, "english")
    assert cleared["docHashColumn"] is None and cleared["description"] is None
    assert A.merged({"tableName": "t"}, None, "english")["language"] == "english" and not A.merged({"tableName": "t"}, None, "english")["makeDefault"]


@pytest.fixture()
def served(spark, tmp_path):
    rows = [(k, f"title {k}", f"word{k % 3} and more text {k}", [float(k), 1.0, 2.0, 3.0]) for k in range(1, 13)]
    docs = spark.createDataFrame(rows, "id long, title string, content string, embedding_qwen array<double>")
    a = Admin(spark, f"file://{tmp_path}/admin")
    a.register({"tableName": "documents", "language": "english", "embeddingDim": 4, "embeddingHnswDim": 2}, docs)
    return a


def test_lifecycle(spark, served):
    a = served
    with pytest.raises(Refused, match="Table does not exist"):
        a.register({"tableName": "nowhere"})
    assert not a.tables()[0]["searchEligible"] and a.bootstrap() == a.bootstrap()
    # back-fill: cancelled after a chunk, taken up again, nothing logged twice
    assert a.prepare_backfill("documents")["total"] == 12
    events = []
    a.run_backfill("documents", 5, events.append, lambda: len(events) >= 2)
    assert [e["event"] for e in events] == ["started", "chunk", "cancelled"] and a.backfill_status("documents")["remaining"] == 7
    a.run_backfill("documents", 5, events.append)
    done = a.backfill_status("documents")
    assert (done["status"], done["processed"], done["remaining"]) == ("completed", 12, 0)
    assert a.index_status("english")["pending"] == 12
    a.run_backfill("documents", 5)
    assert a.index_status("english")["pending"] == 12
    # indexing makes it eligible, and so the default
    assert a.run_index("english")["tasks"] == 12
    t = a.tables()[0]
    assert t["searchEligible"] and t["isDefault"] and t["rowCount"] == t["indexedCount"] == 12
    # documents: insert, update, delete
    made = a.insert("documents", {"content": "brand new words", "embedding": [1, 2, 3, 4]})
    assert (made["id"], made["taskType"]) == (13, "insert") and not a.table("documents")["searchEligible"]
    a.update("documents", "13", {"content": "changed words words"})
    a.delete("documents", 1)
    for bad, error in (({}, "At least one field"), ({"embedding": [1.0]}, "must have 4 dimensions, received 1")):
        with pytest.raises(ValueError, match=error):
            a.update("documents", 2, bad)
    with pytest.raises(Refused, match="Document not found"):
        a.delete("documents", 1)
    with pytest.raises(Refused, match="embedding or embeddingHnsw is required"):
        a.insert("documents", {"content": "x"})
    assert a.run_index("english")["tasks"] == 3 and a.table("documents")["searchEligible"]
    at = a.index("english")
    assert {r.id for r in at.matching(["changed"], "documents").collect()} == {13} and at.matching(["brand"], "documents").count() == 0
    assert {(r.token, r.tf) for r in at.tokens(table="documents").where("id = 13").collect()} == {("changed", 1), ("words", 2)}
    row = a.corpus("documents").read().where("id = 13").first()
    assert row.embedding_hnsw == [1.0, 2.0] and row.textlen == 2 and a.corpus("documents").read().count() == 12
    a.corpus("documents").compact()
    assert a.corpus("documents").read().count() == 12


def test_routes(served):
    ok = lambda *x: A.route(served, *x)["data"][0]
    assert set(ok("GET", "/languages")) >= {"english", "korean"} and ok("GET", "/tables")[0]["tableName"] == "documents"
    assert ok("PUT", "/bm25/english/settings", {"k1": 1.5, "b": 0.6}) | {"suffix": ""} == {"suffix": "", "k1": 1.5, "b": 0.6}
    assert A.route(served, "PUT", "/bm25/klingon/settings", {"k1": 1})["error"] == "Unsupported text search language: klingon"
    assert A.route(served, "GET", "/nothing")["error"].startswith("No such route")
    assert A.route(served, "GET", "/tables/documents/backfill/run", None, {"chunkSize": "0"})["error"] == "chunkSize must be a positive integer"
    assert ok("POST", "/tables/documents/backfill/prepare")["total"] == 12
    events = parse_events("".join(A.route(served, "GET", "/tables/documents/backfill/run", None, {"chunkSize": "6"})))
    assert [e["event"] for e in events] == ["started", "chunk", "chunk", "completed"]
    assert ok("POST", "/tables/documents/backfill/cancel")["cancelRequested"]
    events = parse_events("".join(A.route(served, "GET", "/bm25/english/run")))
    assert [e["event"] for e in events] == ["started", "chunk", "completed"] and ok("GET", "/bm25/english/status")["documents"] == 12
    assert ok("DELETE", "/documents/documents/3")["taskType"] == "delete"


def test_closed_stream_cancels(served):
    served.prepare_backfill("documents")
    stream = A.route(served, "GET", "/tables/documents/backfill/run", None, {"chunkSize": "1"})
    assert next(stream).startswith("event: started")
    stream.close()
    assert served.backfill_status("documents")["status"] == "cancelled"


def test_backfill_error_is_kept(served, monkeypatch):
    monkeypatch.setattr(A.backfill, "process", lambda *x: (_ for _ in ()).throw(RuntimeError("no memory")))
    events = []
    with pytest.raises(RuntimeError):
        served.run_backfill("documents", 5, events.append)
    assert events[-1]["event"] == "error" and served.backfill_status("documents")["lastError"] == "no memory"


def test_default_moves(spark, served):
    other = spark.createDataFrame([(1, "t", "some text", ["some", "text"], 2, [1.0], [1.0])], "id long, title string, content string, fts array<string>, textlen int, embedding_qwen array<double>, embedding_hnsw array<double>")
    served.register({"tableName": "other", "language": "english", "embeddingDim": 1, "embeddingHnswDim": 1}, other)
    served.run_backfill("other")
    served.run_index("english")
    assert {t["tableName"]: t["isDefault"] for t in served.tables()} == {"other": True, "documents": False}
    assert served.names("english") == ["documents", "other"]
