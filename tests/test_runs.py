"""Memory and shuffles that don't grow with the table: back-fill by marks, lists in sorted runs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import index as index_tables
from lodestone.operators import postings
from lodestone.operators.stored import Index
from lodestone.plans import registry

from .conftest import SMALL


def joined_types(plan) -> set[str]:
    """Types of the columns that the joins of an optimised plan get."""
    out = set()
    for k in range(plan.children().size()):
        child = plan.children().apply(k)
        if plan.nodeName() == "Join":
            out |= {child.output().apply(c).dataType().simpleString() for c in range(child.output().size())}
        out |= joined_types(child)
    return out


@pytest.mark.parametrize("name", ["backfill_run", "backfill_count", "backfill_chunk"])
def test_backfill_joins_marks_only(spark, name):
    plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan()
    assert joined_types(plan) <= {"bigint", "boolean", "int"}


def test_lists_in_runs_need_no_sort_of_a_task(spark, tmp_path, monkeypatch):
    """A task's rows come in runs that are sorted as they are made; only long lists that are scored have corners."""
    monkeypatch.setattr(postings, "DOCUMENTS", 64)
    monkeypatch.setattr(postings, "RUN", 1 << 13)
    docs = spark.createDataFrame([("t", k, ["all", f"w{k % 7}", f"only{k}"], 3) for k in range(1000)], "table_name string, id long, tokens array<string>, len int").coalesce(1)
    path = f"file://{tmp_path}/lists"
    postings.write(docs, path)
    rows = spark.read.schema(postings.SCHEMA).parquet(path).collect()
    runs, at = 0, set()
    for before, r in zip([None, *rows], rows):
        if r["token"] == "" and (before is None or before["token"] != ""):
            runs, at = runs + 1, set()
        else:
            assert (before["token"], before["segment"]) < (r["token"], r["segment"])
        if r["token"] == "":
            at.add(r["segment"])
        assert r["segment"] in at
    assert runs > spark.sparkContext.defaultParallelism  # several a task
    index = Index(spark, f"file://{tmp_path}/index").build(docs)
    assert sorted(r.id for r in index.matching(["all", "w3"], "t").collect()) == [k for k in range(1000) if k % 7 == 3]
    assert [r.id for r in index.top(["all", "only5"], "t", 3).collect()] == [5, 999, 998]


def test_short_and_unscored_lists_have_no_corners(spark):
    docs = spark.createDataFrame([("t", k, ["all", f"only{k}"], 2) for k in range(200)], "table_name string, id long, tokens array<string>, len int").coalesce(1)
    assert {r["token"] for r in postings.packed(docs).collect() if r["blocks"]} == {"all"}
    assert not [r for r in postings.packed(docs, None, False).collect() if r["blocks"] or r["most"]]


@pytest.mark.parametrize("seeds, dense", [(1, 1 << 6), (256, 1 << 21)])
def test_many_queries_hand_on_only_what_reaches_the_bound(spark, tmp_path, monkeypatch, seeds, dense):
    """All documents have a word of each query; of each task only those come that can be among a query's best of the whole table."""
    monkeypatch.setattr(postings, "DOCUMENTS", 64)
    monkeypatch.setattr(postings, "SEEDS", seeds)
    monkeypatch.setattr(postings, "DENSE", dense)
    rows = [("t", k, ["all", *["half"] * (k % 2), f"w{k % 50}", f"v{k % 77}"]) for k in range(800)]
    docs = spark.createDataFrame(rows, "table_name string, id long, tokens array<string>").withColumn("len", F.size(F.array_distinct("tokens"))).repartition(6)
    index = Index(spark, f"file://{tmp_path}").build(docs)
    queries = [(k, ["all", "half", f"w{k}", f"v{k}"]) for k in range(40)] + [(99, ["all"])]
    found = index.top_many(spark.createDataFrame(queries, "query_id long, words array<string>"), "t", 5).orderBy("query_id", "place").collect()
    words = {q: own for q, own in queries}
    got: dict = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.id, r.score))
    for q in (0, 7, 39, 99):
        assert got[q] == [(r.id, r.score) for r in index.top(words[q], "t", 5).collect()]
    df = {r.token: r.tfdoc for r in index.frequency().collect()}
    weights = index._weights(sorted(df), "t", 1.2, 0.75)
    asked = postings.Asked(queries[:40], df)
    least = np.array([got[q][4][1] for q in range(40)])
    handed = postings.tops_many(index._lists(), asked, weights, "t", 5, 6, least).collect()
    ties = sum(len([1 for _, s in got[q] if s == got[q][4][1]]) for q in range(40))
    assert 200 <= len(handed) <= 200 + 5 * ties  # every task's best five would be up to 1,200
    assert {r.query_id for r in handed} == set(range(40))


def test_cleaned_texts_give_the_lists_of_analysed_ones(spark):
    """The workers cut words and count lengths as the column functions do."""
    texts = [None, "", " ", "...", "The the  THE cat", " a b　c d\te\nf\x0bg\x0ch\x1ci\x85j ", "İstanbul ΣΣ naïve 1½ x́y", "-dash- under_score", "한국어 漢字。 \U0001d4d0\U0001f600b", "w " * 300 + "v"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 20)], "id long, content string").coalesce(1)
    want, got = postings.packed(index_tables.analysed(docs, "t")).collect(), postings.packed(index_tables.cleaned(docs, "t")).collect()
    assert got == want and len(want) > 20
