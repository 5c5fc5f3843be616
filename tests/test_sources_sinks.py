from __future__ import annotations

import json
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from lodestone import embedding as E
from lodestone import sinks as S
from lodestone.functions import vector as V
from lodestone.sources import files


def test_fetched_once(tmp_path):
    calls = []

    def fetch(url, path):
        calls.append(url)
        with open(path, "w") as f:
            f.write("x")

    path = f"{tmp_path}/a/b.parquet"
    assert files.fetched("http://x", path, fetch) == path == files.fetched("http://x", path, fetch) and calls == ["http://x"]

    def broken(url, part):
        open(part, "w").close()
        raise OSError("gone")

    with pytest.raises(OSError):
        files.fetched("http://x", f"{tmp_path}/c", broken)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a"]


def test_string_list(spark):
    assert [r.query for r in files.string_list(spark, '["a", "b"]').orderBy("n").collect()] == ["a", "b"]
    for bad in ('{"a": 1}', "[1]"):
        with pytest.raises(ValueError):
            files.string_list(spark, bad)


def test_settings(tmp_path):
    (tmp_path / "a.env").write_text("# comment\nPGUSER='ann'\nexport PORT=\"1\"\nbad line\nEMPTY=\n")
    (tmp_path / "b.env").write_text("PGUSER=bob\nHOST=h\n")
    got = files.settings([f"{tmp_path}/a.env", f"{tmp_path}/none", f"{tmp_path}/b.env"], {"PORT": "9"})
    assert got == {"PORT": "9", "PGUSER": "ann", "EMPTY": "", "HOST": "h"}
    assert files.first_of(got, "EMPTY", "HOST") == "h" and files.first_of(got, "NONE", default="d") == "d"


def test_reports(spark, tmp_path):
    path = S.write_report(f"{tmp_path}/out/report.json", {"name": "é", "n": 1})
    assert json.load(open(path, encoding="utf-8")) == {"name": "é", "n": 1}
    df = spark.createDataFrame([("a", 1), ("bb", None)], "k string, v int").orderBy("k")
    text = S.markdown_report("Ops", {"top": df, "bad": df.select(F.raise_error(F.lit("boom")).alias("x"))}, "2026-01-01")
    assert "## top\n\n```text\nk  | v\n---+--\na  | 1\nbb |\n```" in text and "failed:" in text


def test_events():
    event = {"event": "chunk", "tableName": "문서", "processedRows": 3}
    assert S.event_text(event) == 'event: chunk\ndata: {"event": "chunk", "tableName": "문서", "processedRows": 3}\n\n' and S.parse_events(S.event_text(event) * 2) == [event] * 2

    def fails(emit, cancelled):
        emit({"event": "started"})
        raise RuntimeError("x")

    assert [e["event"] for e in S.parse_events("".join(S.event_stream(fails)))] == ["started", "error"]


def test_flush_batches():
    sizes, seen = [], []
    assert S.flush_batches(range(7), lambda b: sizes.append(len(b)), 3, seen.append) == 7
    assert sizes == [3, 3, 1] and seen == [3, 6, 7] and S.flush_batches([], sizes.append) == 0


WORKER = textwrap.dedent(
    """
    import json, sys, time
    print("loading a model")
    print(json.dumps({"event": "ready"}), flush=True)
    for line in sys.stdin:
        asked = json.loads(line)
        if asked["query"] == "slow":
            time.sleep(5)
        if asked["query"] == "die":
            sys.exit(1)
        said = {"id": asked["id"], "error": "no vector"} if asked["query"] == "bad" else {"id": asked["id"], "vector": [float(len(asked["query"]))]}
        print(json.dumps(said), flush=True)
    """
)


def test_worker(tmp_path):
    started = []

    def command(model):
        started.append(model)
        return [sys.executable, "-c", WORKER]

    embed = E.QueryEmbedder(command, ("qwen3",), timeout=2)
    try:
        assert embed.health() == {"configuredModels": ["qwen3"], "readyModels": ["qwen3"], "pendingModels": [], "ready": True}
        assert embed(" abc ") == [3.0] == embed("abc") and embed("  ") is None
        with pytest.raises(RuntimeError, match="no vector"):
            embed("bad")
        with pytest.raises(RuntimeError, match="ended"):
            embed("die")
        assert embed("again") == [5.0] and started == ["qwen3", "qwen3"]
        with pytest.raises(TimeoutError, match="timeout:qwen3"):
            embed("slow")
        embed.remembered.update({("qwen3", f"q{k}"): [0.0] for k in range(E.REMEMBERED)})
        embed.workers["qwen3"].close()
        embed("x" * 9)
        assert ("qwen3", "abc") not in embed.remembered
    finally:
        embed.close()
    with pytest.raises(RuntimeError, match="not-ready"):
        E.Worker([sys.executable, "-c", "pass"], "base", 1)


def test_serve():
    said = []
    E.serve(E.HashingProvider(4), iter(['{"id": 1, "query": "a b"}', "", "nonsense"]), said.append)
    first, answer, broken = map(json.loads, said)
    assert first == {"event": "ready"} and len(answer["vector"]) == 4 and broken["id"] is None and broken["error"]
    assert E.LookupProvider({"a": [1.0]})(["a"]) == [[1.0]]


def test_device():
    assert [E.device(*x) for x in ((True, True, True), (True, False), (False, True), (False, False))] == [("cuda", "bfloat16"), ("cuda", "float16"), ("mps", "float16"), ("cpu", "float32")]


def test_embed_documents(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "a b")], "id long, text string")
    got = {r.id: r.embedding for r in E.embed_documents(df, E.HashingProvider(8), 8).collect()}
    assert got[1] == got[4] == E.HashingProvider(8)(["a b"])[0] and got[2] is got[3] is None


def test_vector_checks(spark):
    for bad, error in (([1.0], "2 dimensions, received 1"), ([1.0, float("nan")], "finite"), ("x", "array of numbers"), ([1.0, None], "array of numbers")):
        with pytest.raises(ValueError, match=error):
            V.validate(bad, 2)
    assert V.validate([1, 2.5], 2) == [1.0, 2.5]
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])], "s array<array<double>>, m array<int>")
    assert [r.v for r in df.select(V.masked_mean(F.col("s"), F.col("m")).alias("v")).collect()] == [[2.0, 3.0], [0.0, 0.0]]
