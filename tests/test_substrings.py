"""Substring search by trigram lists against a scan."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import postings, search, substrings
from lodestone.operators.stored import Index
from lodestone.operators.substrings import Substrings

DOCS = "id long, title string, content string, namespace string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [(k, None if k % 17 == 0 else "".join(rng.choice(list("abÄ "), 6)), None if k % 19 == 0 else "".join(rng.choice(list("abcé 😀%_"), int(rng.integers(0, 60)))), "n") for k in range(500)]
    return [*out, (1000, "", "", None), (1001, "The END", "a_b%c \\ x", None)]


@pytest.fixture(scope="module")
def stored(spark, rows, tmp_path_factory):
    docs = spark.createDataFrame(rows, DOCS)
    before, postings.DOCUMENTS = postings.DOCUMENTS, 100
    try:
        sub = Substrings(spark, f"file://{tmp_path_factory.mktemp('sub')}")
        sub.write(docs)
    finally:
        postings.DOCUMENTS = before
    return docs, sub


@pytest.mark.parametrize("pattern", ["%abc%", "%ab%", "%abca%", "%é 😀%", "%a_c%", "%ab%ca%", "%the end%", "%a\\_b\\%c%", "%zzz%", "%", "a%", "%é%abc%", "%\\%_a%"])
@pytest.mark.parametrize("field", ["title", "content"])
def test_like_equals_a_scan(stored, pattern, field):
    docs, sub = stored
    want = {r.id for r in docs.where(F.lower(F.coalesce(F.col(field), F.lit(""))).like(pattern)).collect()}
    got = [r.id for r in sub.like(docs, field, pattern).collect()]
    assert sorted(got) == sorted(want)


def test_runs_and_grams():
    assert substrings.runs_of("%a_bcd%\\%e\\\\f%") == ["a", "bcd", "%e\\f"]
    assert substrings.grams_of("%abab%x%") == ["aba", "bab"] and substrings.grams_of("%ab_cd%") == []


def test_only_candidates_are_fetched(stored, monkeypatch):
    docs, sub = stored
    asked = []
    real = substrings.fetched
    monkeypatch.setattr(substrings, "fetched", lambda d, ids: asked.append(ids.count()) or real(d, ids))
    sub.like(docs, "content", "%abca%").count()
    assert 0 < asked[0] < 100
    monkeypatch.setattr(substrings, "FETCHED", 1)
    assert sub.like(docs, "content", "%abca%").count() == docs.where("lower(content) LIKE '%abca%'").count()


def test_versions_replace_documents(spark, rows, tmp_path):
    sub = Substrings(spark, f"file://{tmp_path}/sub")
    docs = spark.createDataFrame(rows[:40], DOCS)
    sub.write(docs)
    new = spark.createDataFrame([(3, "needle", "in hay", None), (900, "x", "needle too", None)], DOCS)
    sub.write(new, spark.createDataFrame([(3,), (5,)], "id long"))
    now = docs.where("id NOT IN (3, 5)").unionByName(new)
    for field, pattern in (("title", "%needle%"), ("content", "%needle%"), ("content", "%abc%"), ("content", "%hay%")):
        assert sorted(r.id for r in sub.like(now, field, pattern).collect()) == sorted(r.id for r in now.where(F.lower(F.coalesce(F.col(field), F.lit(""))).like(pattern)).collect())
    assert [r.id for r in sub.title_words(["needle"]).collect()] == [3] and sub.title_words([]).count() == 0


@pytest.mark.parametrize("q,limit,offset", [("abc", 5, 0), ("abc", 5, 3), ("a b", 400, 2), ("the end", 3, 0), ("nowhere at all", 3, 0), ("ab", 4, 0)])
def test_lexical_by_lists_equals_the_scan(spark, stored, rows, tmp_path, q, limit, offset):
    from lodestone.operators import index as I

    docs, sub = stored
    own = Index(spark, f"file://{tmp_path}/index").build(I.analysed(docs, "documents"))
    got = search.lexical_indexed(docs, q, limit, offset, own, "documents", sub).collect()
    assert got == search.lexical(docs, q, limit, offset).collect()
    assert {r.id for r in search.matches_indexed(docs, q, own, "documents", sub).collect()} == {r.id for r in search.matches(docs, q).collect()}
