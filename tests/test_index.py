from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import index
from lodestone.operators import postings
from lodestone.operators.stored import Index
from lodestone.streaming import changes

LOG = "row_id long, task_type int, table_name string, id long, old_len int, old_tokens array<string>, new_len int, new_tokens array<string>"


def test_parse(spark):
    rows = spark.createDataFrame([("'pokémon':1,4 'master':2 'it''s'",)], "v string").select(F.inline(index.parse_tsvector(F.col("v")))).collect()
    assert {(r.token, r.tf) for r in rows} == {("pokémon", 2), ("master", 1), ("it's", 1)}
    index.register_token_stats(spark)
    rows = spark.sql("SELECT * FROM tsvector_token_stats(\"'pokémon':1,4 'master':2 'it''s'\")").collect()
    assert {(r.token, r.tf) for r in rows} == {("pokémon", 2), ("master", 1), ("it's", 1)}


def test_counts_within_a_row(spark):
    docs = spark.createDataFrame([("t", 1, ["b", "a", "b"]), ("t", 2, []), ("t", 3, None), ("t", 4, ["x"])], "table_name string, id long, tokens array<string>")
    assert {tuple(r) for r in index.token_stats(docs).collect()} == {("t", 1, "a", 1), ("t", 1, "b", 2), ("t", 4, "x", 1)}


def test_consolidated_deltas(spark):
    log = spark.createDataFrame(
        [(1, 1, "t", 10, 2, ["pokémon", "master"], 3, ["pokémon", "league", "pokémon"]), (2, 2, "t", 11, 1, ["pikachu"], None, None)],
        LOG,
    )
    tasks = index.consolidate(log)
    assert [tuple(r) for r in index.length_deltas(tasks).collect()] == [("t", -1, 0)]
    assert {tuple(r) for r in index.df_deltas(tasks).collect()} == {("master", -1), ("league", 1), ("pikachu", -1)}
    assert {tuple(r) for r in index.token_deltas(tasks).collect()} == {("master", -1), ("league", 1), ("pikachu", -1), ("pokémon", 1)}


def test_consolidate_keeps_nulls(spark):
    log = spark.createDataFrame([(1, 0, "t", 10, None, None, 2, ["a", "b"]), (2, 1, "t", 10, 2, ["a", "b"], 3, ["a", "c", "a"])], LOG)
    r = index.consolidate(log).first()
    assert (r.initial_len, r.initial_tokens, r.final_len, r.final_tokens, r.n_tasks) == (None, None, 3, ["a", "c", "a"], 2)


def same_index(a: Index, b: Index) -> None:
    for table in ("tokens", "frequency", "lengths"):
        got, want = getattr(a, table)(), getattr(b, table)()
        columns = sorted(want.columns)
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())), table


@pytest.fixture()
def changed(spark, tmp_path):
    """An index, its change log in two files, and the documents after all changes."""
    docs = spark.createDataFrame([("t", k, [f"w{k % 3}", "x", "x"]) for k in range(20)], "table_name string, id long, tokens array<string>").withColumn("len", F.size(F.array_distinct("tokens")))
    updates = spark.createDataFrame([(k, 1, "t", k, 2, [f"w{k % 3}", "x", "x"], 1, ["y"]) for k in range(0, 20, 2)], LOG)
    deletes = spark.createDataFrame([(100 + k, 2, "t", k, 1, ["y"], None, None) for k in range(0, 20, 4)], LOG)
    source = f"file://{tmp_path}/log"
    updates.coalesce(1).write.parquet(source)
    final = docs.where("id % 2 = 1").unionByName(docs.where("id % 4 = 2").withColumn("tokens", F.array(F.lit("y"))).withColumn("len", F.lit(1)))
    return Index(spark, f"file://{tmp_path}/index").build(docs), source, deletes, Index(spark, f"file://{tmp_path}/want").build(final)


def test_stream_equals_full_build(spark, tmp_path, changed):
    own, source, deletes, want = changed
    events = []
    changes.maintain(spark, source, own.folder, f"file://{tmp_path}/checkpoint", 100, events.append)
    deletes.coalesce(1).write.mode("append").parquet(source)
    changes.maintain(spark, source, own.folder, f"file://{tmp_path}/checkpoint", 100, events.append)
    assert own.versions() == (0, 2) and own.applied() == 116
    same_index(own, want)
    assert [e["event"] for e in events] == ["started", "chunk", "completed"] * 2 and events[-1]["tasks"] == 5
    assert own.compact() == 3 and own.versions() == (3, 3)
    same_index(own, want)
    own.vacuum()
    same_index(own, want)
    assert {r.id for r in own.matching(["w1", "x"], "t").collect()} == {1, 7, 13, 19} and own.matching([], "t").count() == 0


def test_cancelled_chunk_is_taken_up_again(spark, tmp_path, changed):
    own, source, deletes, want = changed
    deletes.coalesce(1).write.mode("append").parquet(source)
    last = changes.maintain(spark, source, own.folder, f"file://{tmp_path}/checkpoint", cancelled=lambda: True)
    assert last == {"event": "cancelled", "batches": 0, "tasks": 0} and own.versions() == (0, 0)
    changes.maintain(spark, source, own.folder, f"file://{tmp_path}/checkpoint")  # tasks are ordered by row_id, whatever their file
    same_index(own, want)


def test_chunks_of_the_log(spark, tmp_path):
    """250 tasks in chunks of 100, with a compaction and a lost checkpoint in between, equal to a full build."""
    docs = lambda ids, word: spark.createDataFrame([("t", k, [word, f"w{k % 7}"], 2) for k in ids], "table_name string, id long, tokens array<string>, len int")
    own = Index(spark, f"file://{tmp_path}/index").build(docs(range(50), "old"))
    log = spark.createDataFrame([(1000 + k, 1 if k < 50 else 0, "t", k, 2 if k < 50 else None, ["old", f"w{k % 7}"] if k < 50 else None, 2, ["new", f"w{k % 7}"]) for k in range(250)], LOG)
    source = f"file://{tmp_path}/log"
    log.where("id < 130").repartition(3).write.parquet(source)
    events = []
    changes.maintain(spark, source, own.folder, f"file://{tmp_path}/checkpoint", 100, events.append)
    assert [e["processed"] for e in events if e["event"] == "chunk"] == [100, 30]
    base = own.compact()
    log.where("id >= 130").repartition(3).write.mode("append").parquet(source)
    changes.maintain(spark, source, own.folder, f"file://{tmp_path}/another", 50, events.append)
    assert [e["processed"] for e in events if e["event"] == "chunk"] == [100, 30, 50, 50, 20]
    assert own.versions() == (base, base + 3)
    same_index(own, Index(spark, f"file://{tmp_path}/want").build(docs(range(250), "new")))
    events.clear()
    whole = Index(spark, f"file://{tmp_path}/again").build(docs(range(50), "old"))
    changes.maintain(spark, source, whole.folder, f"file://{tmp_path}/third", 100, events.append)
    assert [e.get("processed") for e in events] == [None, 100, 100, 50, None] and events[0] == {"event": "started", "chunkSize": 100}
    same_index(own, whole)


def test_random_batches_reruns_and_compactions(spark, tmp_path):
    """Batches, each sometimes twice, and compactions at random places equal a full build of what is left."""
    rng = np.random.default_rng(6)
    now = {k: [f"a{k % 3}"] for k in range(10)}
    frame = lambda rows: spark.createDataFrame([("t", k, w, len(set(w))) for k, w in rows.items()], "table_name string, id long, tokens array<string>, len int")
    own, row = Index(spark, f"file://{tmp_path}/index").build(frame(now)), 0
    for step in range(7):
        tasks = []
        for k in rng.integers(0, 15, 6).tolist():
            old, new = now.get(k), None if rng.random() < 0.3 else [f"b{x}" for x in rng.integers(0, 4, int(rng.integers(0, 4))).tolist()]
            if old is None and new is None:
                continue
            tasks.append((row, 0 if old is None else 1 if new is not None else 2, "t", k, None if old is None else len(set(old)), old, None if new is None else len(set(new)), new))
            row += 1
            now.pop(k, None) if new is None else now.__setitem__(k, new)
        log = spark.createDataFrame(tasks, LOG)
        first = own.apply(log, f"to-{row}")
        if rng.random() < 0.5:
            own.compact()
        if rng.random() < 0.7:
            assert own.apply(log, f"to-{row}") == first  # it comes again
    same_index(own, Index(spark, f"file://{tmp_path}/want").build(frame(now)))
    with pytest.raises(ValueError, match="isn't above"):
        own.build(frame(now), 0)
    with pytest.raises(ValueError, match="no base"):
        Index(spark, f"file://{tmp_path}/none").apply(log)


@pytest.fixture(scope="module")
def ranked(spark, tmp_path_factory):
    """An index of several segments and blocks, and its documents."""
    rng = np.random.default_rng(9)
    vocabulary = [f"t{k}" for k in range(60)]
    weights = 1 / np.arange(1, 61)
    docs = [(k, [str(w) for w in rng.choice(vocabulary, int(rng.integers(0, 40)), p=weights / weights.sum())]) for k in range(3000)]
    rows = [("t" if k % 10 else "u", k, w if k % 501 else None, len(set(w)) if k % 501 else 0) for k, w in docs]
    before, postings.DOCUMENTS = postings.DOCUMENTS, 400
    try:
        own = Index(spark, f"file://{tmp_path_factory.mktemp('ranked')}").build(spark.createDataFrame(rows, "table_name string, id long, tokens array<string>, len int"))
    finally:
        postings.DOCUMENTS = before
    return own, rows


def plain_scores(rows, words, table, k1=1.2, b=0.75):
    n = len(rows)
    df = {w: sum(w in (t or ()) for _, _, t, _ in rows) for w in words}
    lengths = [size for name, _, _, size in rows if name == table]
    avg = sum(lengths) / len(lengths)
    out = {}
    for name, k, tokens, size in rows:
        if name == table and (found := [w for w in words if w in (tokens or ())]):
            out[k] = round(sum(postings.idf(n, df[w]) * tokens.count(w) * (k1 + 1) / (tokens.count(w) + k1 * (1 - b + b * size / avg)) for w in found), 6)
    return out


@pytest.mark.parametrize("words", [["t0"], ["t0", "t1"], ["t3", "t50", "t59"], ["t59", "nowhere"]])
def test_top_by_blocks(ranked, words):
    own, rows = ranked
    want = plain_scores(rows, words, "t")
    got = {r.id: r.score for r in own.score(words, "t").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    best = sorted(got.items(), key=lambda x: (-x[1], -x[0]))
    for k in (1, 10, 4000):
        assert [(r.id, r.score) for r in own.top(words, "t", k).collect()] == best[:k]
    blocks = own.skipped(words, "t", 1).first()
    assert 0 < blocks.blocks_read <= blocks.blocks
    assert {r.id for r in own.matching(words, "t").collect()} == {k for name, k, t, _ in rows if name == "t" and all(w in (t or ()) for w in words)}
    assert {r.id for r in own.score(words, "t", ids=[1, 2, 3, 4, 5]).collect()} == {k for k in want if k <= 5}


def test_blocks_are_skipped(spark, tmp_path):
    """One document has a word often, so the blocks of the others can't reach it."""
    rows = [("t", k, ["x"] * (50 if k == 700 else 1) + ["y"], 2) for k in range(2000)]
    own = Index(spark, f"file://{tmp_path}/index").build(spark.createDataFrame(rows, "table_name string, id long, tokens array<string>, len int").coalesce(1))
    assert own.top(["x"], "t", 1).first().id == 700
    r = own.skipped(["x"], "t", 1).first()
    assert r.blocks_read < r.blocks


def test_tables_and_empty_documents_in_segments(ranked):
    own, rows = ranked
    got = {(r.table_name, r.recordcount, r.sumlen) for r in own.lengths().collect()}
    assert got == {(t, sum(r[0] == t for r in rows), sum(r[3] for r in rows if r[0] == t)) for t in "tu"}
    own.compact()
    assert {(r.table_name, r.recordcount, r.sumlen) for r in own.lengths().collect()} == got
    assert sum(r.n for r in own._lists().where("token = ''").collect()) == len(rows)


def test_scores_of_unknown_words(spark, changed):
    own = changed[0]
    assert own.score(["nowhere"], "t").count() == 0 and own.score([], "t").count() == 0 and own.score(["x"], "other").count() == 0
    assert {r.id for r in own.score(["w1", "nowhere"], "t", ids=[1, 2, 4]).collect()} == {1, 4}


def test_chunk_size():
    assert [changes.chunk_size(n) for n in (None, 0, 7.9, 10**6)] == [100, 1, 7, 1000]
