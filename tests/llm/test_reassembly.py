"""Transaction logs against a plain machine that reads one source after the other."""

from __future__ import annotations

import zlib
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import reassembly
from lodestone.llm.queries import QUERIES
from tests.conftest import SMALL

LOG = "pos long, source string, kind string, key long, value long"


def null_first(x):
    return (x is not None, x if x is not None else 0)


def plain(rows, per_epoch=4):
    """(states, undone) of rows (pos, source, kind, key, value)."""
    rows = [r for r in rows if r[0] is not None]
    source_of = lambda r: (r[1] is not None, r[1] or "")
    order = lambda r: (source_of(r), r[0], r[2], null_first(r[3]), null_first(r[4]))
    undone, applied = [], []
    commits = sorted((r[0], source_of(r)) for r in rows if r[2] == "commit")
    for source, own in groupby(sorted(rows, key=order), key=source_of):
        stack, ended = [[]], set()
        for pos, _, kind, key, value in own:
            if kind == "change":
                stack[-1].append((pos, key, value))
            elif kind == "savepoint":
                stack.append([])
            elif kind == "rollback":
                undone += [("rollback", p, pos, k) for p, k, _ in stack.pop()]
                stack = stack or [[]]
            else:
                for p, k, v in (c for frame in stack for c in frame):
                    if kind == "abort":
                        undone.append(("abort", p, pos, k))
                    else:
                        applied.append(((pos, source), p, null_first(v), k, v))
                stack = [[]]
        undone += [("abort", p, None, k) for frame in stack for p, k, _ in frame]
    states, store, place = [], {}, 0
    applied.sort(key=lambda a: a[:3])
    first = {c: k for k, c in reversed(list(enumerate(commits)))}
    for epoch in range(-(-len(commits) // per_epoch)):
        while place < len(applied) and first[applied[place][0]] < (epoch + 1) * per_epoch:
            _, _, _, key, value = applied[place]
            store.pop(key, None) if value is None else store.__setitem__(key, value)
            place += 1
        states.append((epoch + 1, len(store), sum(store.values())))
    return states, undone


def ordered(rows):
    return sorted(tuple(r) for r in rows) if all(None not in r for r in rows) else sorted((tuple(r) for r in rows), key=lambda r: [null_first(x) if not isinstance(x, str) else (True, x) for x in r])


def held(spark, rows, per_epoch=4):
    df = spark.createDataFrame(rows, LOG).repartition(3)
    done = reassembly.reassemble(df, per_epoch)
    states, undone = plain(rows, per_epoch)
    assert ordered(done.undone.select("kind", "pos", "by_pos", "key").collect()) == ordered(undone)
    assert ordered(reassembly.states(done).collect()) == ordered(states)
    return done


@pytest.mark.parametrize("slices", [1, 4, 13])
def test_random_logs(spark, slices):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        rng = np.random.default_rng(slices)
        rows = []
        for pos in range(900):
            source = "hot" if rng.random() < 0.5 else [None, "", "a", "b", "hot2"][int(rng.integers(5))]
            kind = ["commit", "abort", "savepoint", "rollback", "change"][int(rng.choice(5, p=[0.02, 0.01, 0.12, 0.15, 0.7]))]  # transactions over several slices
            change = kind == "change"
            rows.append((pos if pos % 97 else pos - 1, source, kind, int(rng.integers(12)) if change else None, int(rng.integers(1000)) if change and rng.random() < 0.8 else None))
        held(spark, rows, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_edges(spark):
    c = lambda pos, source, key, value: (pos, source, "change", key, value)
    r = lambda pos, source, kind: (pos, source, kind, None, None)
    held(spark, [c(1, "a", 1, 5)])  # the log's end undoes
    held(spark, [r(1, "a", "rollback"), r(2, "a", "rollback"), c(3, "a", 1, 1), r(4, "a", "savepoint"), c(5, "a", 2, 2), r(6, "a", "rollback"), r(7, "a", "rollback"), r(8, "a", "commit")])
    held(spark, [c(None, "a", 1, 5), c(1, None, 1, 5), r(2, None, "commit"), r(2, "a", "commit"), r(2, None, "commit"), c(3, None, 1, None), r(4, None, "commit"), r(5, "b", "commit"), r(6, "b", "commit")], 2)
    held(spark, [c(1, "a", 1, 5), c(1, "a", 1, 5), c(1, "a", 1, 7), r(1, "a", "commit"), r(9, "z", "abort")])  # 'change' comes before 'commit' at one position
    done = held(spark, [])
    assert done.epochs == 0


def test_a_source_that_never_ends(spark):
    """One transaction with all rows: it is cut into slices, and no task has more than its share."""
    n = 6000
    rows = [(k, "one", "savepoint" if k % 10 == 3 else "rollback" if k % 50 == 7 else "change", k % 7, k) for k in range(n)]
    done = held(spark, [(p, s, k, key if k == "change" else None, v if k == "change" else None) for p, s, k, key, v in rows])
    assert done.writes.count() == 0 and {r.kind for r in done.undone.select("kind").distinct().collect()} == {"abort", "rollback"}


def test_documents_against_plain(spark):
    """The query over the documents, with the contract's hashes by zlib."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 1").collect()}
    rows = []
    for d in docs.collect():
        h = zlib.crc32(str(d.doc_id).encode())
        kind, key = {0: "commit", 1: "commit", 2: "abort", 3: "savepoint", 4: "savepoint", 5: "rollback", 6: "rollback"}.get(h % 23, "change"), h // 100 % 300
        value = None if d.text is None or d.doc_id in toxic else zlib.crc32(f"{key}:{d.text}".encode())
        rows.append((d.doc_id, d.source, kind, *((key, value) if kind == "change" else (None, None))))
    states, undone = plain(rows)
    got = [tuple(r) for r in QUERIES["op12_log_reassembly"](spark, SMALL).select("kind", "id", "n", "value").collect()]
    assert ordered(got) == ordered([("state", *s) for s in states] + [(kind, p, by, k) for kind, p, by, k in undone])


def test_nulls_and_clashing_columns(spark):
    docs = spark.createDataFrame([(k, None if k % 9 == 0 else f"t{k}", None, k, "x", 1) for k in range(400)] + [(None, "t", "s", 1, "x", 1)], "doc_id long, text string, source string, pos long, kind string, value int")
    labels = spark.createDataFrame([(5, 1), (5, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    log = reassembly.document_log(docs, labels)
    rows = [tuple(r) for r in log.collect()]
    assert len(rows) == 400
    done = held(spark, rows)
    texts = {r.key: (r.doc_id, r.text) for r in reassembly.stored(done, docs).collect()}
    last = {r.key: r.last for r in reassembly.last_writes(done.writes).collect()}
    assert texts == {k: (v.pos, f"t{v.pos}") for k, v in last.items() if v.value is not None}
    empty = reassembly.document_log(docs.where("false"), labels)
    assert reassembly.digest(reassembly.reassemble(empty)).count() == 0
    assert log.where(F.col("pos").isNull()).count() == 0
