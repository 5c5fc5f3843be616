"""Many queries at once and the word ladder over lists, against one query at a time and a scan."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluate, postings, search, stored
from lodestone.operators.stored import Index
from lodestone.operators.substrings import Substrings

DOCS = "table_name string, id long, tokens array<string>"
LOG = "row_id long, task_type int, table_name string, id long, old_len int, old_tokens array<string>, new_len int, new_tokens array<string>"


def indexed(spark, folder, rows) -> Index:
    before, postings.DOCUMENTS = postings.DOCUMENTS, 64
    try:
        return Index(spark, folder).build(spark.createDataFrame(rows, DOCS).withColumn("len", F.size(F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))))))
    finally:
        postings.DOCUMENTS = before


@pytest.fixture(scope="module")
def corpus_index(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    rows = [("t", k, [f"w{int(x)}" for x in rng.zipf(1.5, int(rng.integers(0, 30))) if x < 500]) for k in range(600)]
    rows += [("t", 1000 + k, ["w1", "w2", "tie"]) for k in range(30)] + [("t", 2000, None), ("other", 5, ["w1", "only"])]
    return indexed(spark, f"file://{tmp_path_factory.mktemp('many')}", rows)


QUERIES = [(1, ["w1", "w2"]), (2, ["tie"]), (3, ["none", "w7", "w7"]), (4, ["none"]), (5, []), (6, None), (7, [None, "", "w3"]), (None, ["w2"]), (8, ["only", "w1"]), (9, ["w4", "w300", "w1", "w9"])]


def by_query(found):
    out: dict = {}
    for r in sorted(found.collect(), key=lambda r: r.place):
        out.setdefault(r.query_id, []).append((r.id, round(r.score, 6)))
    return out


def one_at_a_time(index, queries, k):
    out = {}
    for query, words in queries:
        words = [w for w in dict.fromkeys(words or []) if w]
        rows = sorted(((round(r.score, 6), r.id) for r in index.score(words, "t").collect()), reverse=True)[:k] if words else []
        if rows:
            out[query] = [(i, s) for s, i in rows]
    return out


@pytest.mark.parametrize("words_a_pass", [1 << 16, 3])
def test_many_equal_one_at_a_time(spark, corpus_index, monkeypatch, words_a_pass):
    monkeypatch.setattr(stored, "PASS", words_a_pass)
    queries = spark.createDataFrame(QUERIES, "query_id long, words array<string>")
    assert by_query(corpus_index.top_many(queries, "t", 7)) == one_at_a_time(corpus_index, QUERIES, 7)


def test_ties_go_to_the_larger_id_and_rows_of_one_id_are_one_query(spark, corpus_index):
    queries = spark.createDataFrame([(2, ["tie"]), (2, ["tie"])], "query_id long, words array<string>")
    assert [i for i, _ in by_query(corpus_index.top_many(queries, "t", 5))[2]] == [1029, 1028, 1027, 1026, 1025]


def test_no_queries_and_no_documents(spark, corpus_index, tmp_path):
    none = spark.createDataFrame([], "query_id long, words array<string>")
    assert corpus_index.top_many(none, "t", 5).count() == 0
    assert indexed(spark, f"file://{tmp_path}", []).top_many(spark.createDataFrame([(1, ["a"])], none.schema), "t", 5).count() == 0


def test_many_after_changes(spark, tmp_path):
    index = indexed(spark, f"file://{tmp_path}", [("t", k, ["x", f"y{k % 3}"]) for k in range(40)])
    index.apply(spark.createDataFrame([(1, 1, "t", 4, 2, ["x", "y1"], 3, ["x", "x", "z"]), (2, 2, "t", 5, 2, ["x", "y2"], None, None), (3, 0, "t", 90, None, None, 1, ["z"])], LOG))
    queries = [(1, ["z", "x"]), (2, ["y2"])]
    got = by_query(index.top_many(spark.createDataFrame(queries, "query_id long, words array<string>"), "t", 20))
    assert got == one_at_a_time(index, queries, 20)
    assert [i for i, _ in got[1][:2]] == [90, 4] and 5 not in [i for i, _ in got[2]]
    index.compact()
    assert by_query(index.top_many(spark.createDataFrame(queries, "query_id long, words array<string>"), "t", 20)) == got


def test_quality_rows(spark):
    docs = spark.createDataFrame([(1, "red fox", "a red fox ran"), (2, None, "blue"), (3, "x", None)], "id long, title string, content string")
    queries = spark.createDataFrame([(1, ["red", "fox"]), (2, ["blue", "fox", "no"]), (3, []), (9, ["q"])], "query_id long, words array<string>")
    found = spark.createDataFrame([(1, 1, 1, 2.0), (1, 2, 2, 1.0), (2, 1, 1, 2.0), (2, 2, 2, 1.0)], "query_id long, place long, id long, score double")
    rows = evaluate.quality(found, queries, docs)
    assert sorted(map(tuple, rows.collect())) == [(1, 1, 1, 1.0), (2, 1, 2, 0.333), (3, None, None, 0.0), (9, None, None, 0.0)]
    assert tuple(evaluate.quality_rates(rows).first()) == (4, 0.5, 0.25, 0.5, 0.375, 0.33)


@pytest.fixture(scope="module")
def ladder(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    words = ["abc", "abcd", "xabc", "de", "the", "end"]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(k, None if k % 11 == 0 else text(2), None if k % 13 == 0 else text(int(rng.integers(0, 12))), "n") for k in range(400)]
    rows += [(1000 + k, "t", "the  end abczzz", "n") for k in range(40)]
    docs = spark.createDataFrame(rows, "id long, title string, content string, namespace string")
    sub = Substrings(spark, f"file://{tmp_path_factory.mktemp('ladder-sub')}")
    sub.write(docs)
    index = indexed(spark, f"file://{tmp_path_factory.mktemp('ladder')}", [("documents", r[0], r[2].split() if r[2] else []) for r in rows])
    return docs, index, sub


@pytest.mark.parametrize("tested", [512, 30, 3])
@pytest.mark.parametrize("q", ["abc", "the end", "abc de", "abczzz", "bcd", "nothing here", "de", "", "a%c"])
def test_word_ladder_over_lists(spark, ladder, monkeypatch, q, tested):
    docs, index, sub = ladder
    monkeypatch.setattr(search, "TESTED", tested)
    scores = index.score(q.split(), "documents")
    want = search.lexical_fallback(docs, scores, q, 12, 3)
    got = search.lexical_fallback_indexed(docs, scores, q, 12, 3, index, "documents", sub)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


def test_queries_of_the_same_words_are_searched_once(spark, corpus_index, monkeypatch):
    """Order, repeats and query_id make no difference; each query gets its rows."""
    asked, search_for = [], postings.tops_many
    monkeypatch.setattr(postings, "tops_many", lambda rows, many, *more: (asked.append([tuple(many.words[w] for w in many.word)]), search_for(rows, many, *more))[1])
    queries = [(k, ["w1", "w2", "w7"] if k % 2 else ["w7", None, "w2", "w1", "w2"]) for k in range(300)] + [(None, ["w7", "w1", "w2"])]
    got = by_query(corpus_index.top_many(spark.createDataFrame(queries, "query_id long, words array<string>"), "t", 5))
    assert len(asked) == 2 and all(sorted(words) == ["w1", "w2", "w7"] for pass_ in asked for words in pass_)
    (rows,) = one_at_a_time(corpus_index, queries[:1], 5).values()
    assert got == {q: rows for q, _ in queries}


class Task:
    """Stands in for a table of lists: keeps the function of its tasks."""

    def __init__(self, spark):
        self.sparkSession = spark

    def where(self, *_):
        return self

    select = where

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_documents_that_cannot_reach_the_bound_are_not_looked_at(spark, tmp_path, monkeypatch):
    """Of long and short documents with frequent words only few can be among the best: the weights of few pairs are looked up."""
    rng = np.random.default_rng(3)
    rows = [("t", k, [f"w{int(x)}" for x in rng.zipf(1.2, 6 if k % 20 == 0 else 60) if x < 3000]) for k in range(2000)]
    index = Index(spark, f"file://{tmp_path}").build(spark.createDataFrame(rows, DOCS).withColumn("len", F.size(F.array_distinct("tokens"))).coalesce(1))
    queries = [(k, list(dict.fromkeys(rows[k][2]))[:8]) for k in range(5, 17)]
    df = {r.token: r.tfdoc for r in index.frequency().collect()}
    many, weights = postings.Asked(queries, df), index._weights(list(df), "t", 1.2, 0.75)
    want = one_at_a_time(index, queries, 5)
    looked, terms = [], postings.Segment.terms
    monkeypatch.setattr(postings.Segment, "terms", lambda self, row, doc: (looked.append(len(row)), terms(self, row, doc))[1])
    lists = index._lists().select("table_name", "token", "segment", "docs", "tfs").toArrow().to_batches()
    found = [r for b in postings.tops_many(Task(spark), many, weights, "t", 5, 6, np.array([want[q][4][1] for q, _ in queries])).run(iter(lists)) for r in b.to_pylist()]
    got: dict = {}
    for r in sorted(found, key=lambda r: (-round(r["score"], 6), -r["id"])):
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 6)))
    assert got == want
    assert sum(looked) < 0.1 * sum(df[w] for _, words in queries for w in words)


def test_the_table_of_frequent_words_is_bounded(monkeypatch):
    """Words beyond its cells are looked up in their lists, with the same weights."""
    monkeypatch.setattr(postings, "TABLE", 300)
    sizes = np.array([100, 50, 100, 40, 3])
    place = np.concatenate([np.arange(n) for n in sizes])
    idf = np.arange(1.0, 6.0)
    own = postings.Segment(np.full(100, 10, np.int32), sizes, place, np.ones(len(place), np.int64), idf, postings.Weights({}, 10.0, 1.2, 0.75))
    assert own.full.size <= 300
    row, doc = np.repeat(np.arange(5), 100), np.tile(np.arange(100), 5)
    assert np.allclose(own.terms(row, doc), np.where(doc < sizes[row], idf[row], 0.0))
