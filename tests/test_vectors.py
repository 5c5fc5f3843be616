"""Vector searches over stored queries: exact by tiles, and by graphs and compressed lists with a floor of recall."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import vector as V
from lodestone.operators import ann, compressed, evaluate, graph, tiles
from lodestone.plans import registry

from .conftest import SMALL


def frame(spark, x, ids=None):
    rows = [(int(i), None if v is None else [float(y) for y in v]) for i, v in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def plain(x, asked, k):
    unit = {i: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, v in enumerate(x) if v is not None and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    out = {}
    for q in asked:
        if q in unit:
            found = sorted((round(1 - float(unit[q] @ u), 9), i) for i, u in unit.items() if i != q and len(u) == len(unit[q]))[:k]
            out[q] = [i for _, i in found]
    return out


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(4)
    x = [rng.normal(size=8) for _ in range(120)] + [None, np.zeros(8), np.full(8, np.nan), np.ones(5), np.ones(5) * 3]
    return x + [x[0]] * 30  # ties


@pytest.mark.parametrize("lane,tile,block", [(1 << 15, 256, 1 << 12), (20, 3, 7)])
def test_neighbors_by_tiles(spark, odd, lane, tile, block, monkeypatch):
    for name, value in (("LANE", lane), ("TILE", tile), ("BLOCK", block)):
        monkeypatch.setattr(tiles, name, value)
    v = frame(spark, odd)
    got = {}
    for r in evaluate.neighbors(v, v.where("id % 3 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == plain(odd, range(0, len(odd), 3), 5)
    assert evaluate.neighbors(v.where("false"), v, 5).count() == 0 and evaluate.neighbors(v, v.where("false"), 5).count() == 0
    assert "Broadcast" not in evaluate.neighbors(v, v, 5)._jdf.queryExecution().toString()


@pytest.mark.parametrize("few", [1024, 10])
def test_graphs_of_shards(spark, tmp_path, few, monkeypatch):
    monkeypatch.setattr(graph, "FEW", few)  # queries sent with the task, or dealt to the shards
    rng = np.random.default_rng(few)
    x = rng.normal(size=(900, 16))
    x[300:330] = x[300]  # copies
    v = frame(spark, [*x, None, np.zeros(16)])
    g = graph.Graphs(spark, f"file://{tmp_path}/g").build(v, shard=250)
    asked = v.where("id % 20 = 0 AND embedding IS NOT NULL")
    assert g.rows.select("shard").distinct().count() == 4
    found, want = g.search(asked, 10, 40), evaluate.neighbors(v, asked, 10)
    far = want.groupBy("query_id").agg(F.max("distance").alias("far"))
    hits = found.join(far, "query_id").where("distance <= far + 0.00001").count()  # copies are as near as each other
    assert hits >= 0.9 * want.count() and found.where("id = query_id").count() == 0
    share = g.compared(asked, 10, 40).agg(F.avg("share"), F.count("*")).first()
    assert 0 < share[0] < 1 and share[1] == asked.count()
    assert g.search(v.where("id = 901"), 3).count() == 0


def test_graph_finds_its_way():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24)) * 5
    x = (centres[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 24))).astype(np.float32)  # clusters
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = graph.Graph(np.arange(4000), x, graph.built(x))
    q = x[::40]
    best, score, seen = g.search(q, 64)
    true = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(b.tolist()) & set(t.tolist())) / 10 for b, t in zip(best, true)]) >= 0.9 and seen.mean() < 1600
    for n in (0, 1, 2, 30):
        tiny = graph.Graph(np.arange(n), x[:n], graph.built(x[:n]))
        assert n == 0 or sorted(tiny.search(x[:1], 40)[0][0].tolist())[-n:] == list(range(n))


@pytest.mark.parametrize("few", [1024, 10])
def test_compressed_lists(spark, tmp_path, few, monkeypatch):
    monkeypatch.setattr(compressed, "FEW", few)
    monkeypatch.setattr(compressed, "PACK", 100)
    rng = np.random.default_rng(few)
    v = frame(spark, [*rng.normal(size=(1500, 30)), None, np.zeros(30)])  # 30 isn't a multiple of a part
    c = compressed.Compressed(spark, f"file://{tmp_path}/c").build(v, lists=8)
    asked = v.where("id % 20 = 0 AND embedding IS NOT NULL")
    found = c.search(asked, 10, probes=7, fetched=100)
    recall = evaluate.recall(evaluate.neighbors(v, asked, 10), found).agg(F.avg("recall")).first()[0]
    assert recall >= 0.85 and found.where("id = query_id").count() == 0
    assert c.codes.selectExpr("sum(octet_length(ids)) / 8").first()[0] == 1500
    assert found.groupBy("query_id").count().where("count <> 10").count() == 0 and c.share(found, 100).where("share < 0.35").count() == asked.count()
    assert compressed.Compressed(spark, f"file://{tmp_path}/e").build(v.where("false")).search(asked, 3).count() == 0


def test_recall_floors(spark):
    for name in ("ann_graph_recall", "ann_compressed_recall"):
        rows = registry.QUERIES[name](spark, SMALL).collect()
        assert rows and sum(r.recall for r in rows) / len(rows) >= 0.9, name


def test_decimals_as_printf(spark):
    """Ties of the exact value go to the even digit; values whose shortest form only looks like a tie are rounded by their exact value."""
    rng = np.random.default_rng(2)
    x = [0.103515625, -0.103515625, 0.0009765625, 1.005, 0.000000125, 2.5e-7, -1e-12, 0.0, 7.0, *(rng.integers(0, 10**9, 2000) / 1e9), *rng.normal(size=500), *(rng.integers(1, 2**20, 500) / 2.0**20)]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for digits in (3, 6, 8):
        assert all(r.s == f"{r.x:.{digits}f}" for r in df.select("x", V.fixed(F.col("x"), digits).alias("s")).collect()), digits
    row = spark.createDataFrame([([float("nan"), float("inf"), None, float("-inf"), 0.103515625],)], "v array<double>").select(V.render(F.col("v")).alias("s")).first()
    assert row.s == "[nan,inf,-inf,0.10351562]"


@pytest.mark.parametrize("lane,block", [(1 << 15, 1 << 12), (20, 7)])
def test_lists_meet_their_queries_in_tiles(spark, odd, tmp_path, lane, block, monkeypatch):
    """All lists probed give the exact neighbours, with ties, vectors of other sizes and none; lists are cut into lanes, and no rows are paired by a join."""
    monkeypatch.setattr(tiles, "LANE", lane)
    monkeypatch.setattr(tiles, "BLOCK", block)
    v = frame(spark, [x if x is None or len(x) == 8 else None for x in odd])
    lists = ann.Lists(spark, f"file://{tmp_path}/l").build(v.where("NOT exists(embedding, x -> isnan(x))"), 6)
    asked = v.where("id % 3 = 0")
    found = lists.search(asked, 5, 6)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == plain([x if x is None or len(x) == 8 else None for x in odd], range(0, len(odd), 3), 5)
    assert "Join" not in found._jdf.queryExecution().toString()
    assert lists.search(v.where("false"), 5, 6).count() == 0
    assert ann.Lists(spark, f"file://{tmp_path}/e").build(v.where("false"), 6).search(asked, 3, 2).count() == 0


@pytest.mark.parametrize("few", [1024, 10])
def test_a_list_hands_on_its_best_only(spark, tmp_path, few, monkeypatch):
    """A list of many packs gives as many candidates of a query as are fetched, not as many of each pack."""
    monkeypatch.setattr(compressed, "FEW", few)
    monkeypatch.setattr(compressed, "PACK", 20)
    v = frame(spark, np.random.default_rng(5).normal(size=(600, 8)))
    c = compressed.Compressed(spark, f"file://{tmp_path}/c").build(v, lists=2)
    asked = v.where("id % 20 = 0")
    rows = c.candidates(asked, 2, 15).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("codes").alias("codes")).collect()
    # Where queries go with the task a row of the table (a pack) is a list's part of its own.
    assert len(rows) == 30 and all(r.codes == 600 for r in rows)
    assert few == 1024 or all(r.n == 30 for r in rows)
