from __future__ import annotations

import pytest

from lodestone.plans import registry

from .compare import same
from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(name, spark):
    same(registry.QUERIES[name], registry.ORACLE_SQL[name], spark, SMALL)


def test_queries_without_sql_run(spark):
    for name in set(registry.QUERIES) - set(registry.ORACLE_SQL):
        assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_ann_recall(spark):
    rows = registry.QUERIES["ann_recall"](spark, SMALL).collect()
    assert sum(r.recall for r in rows) / len(rows) >= 0.9


def test_tsvector_parse_all_documents(spark, tmp_path):
    texts = {3: "a b a", 99: "it's it's", 100: "x", 250: "b c b b", 10**6: None, 10**6 + 1: "é 7"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.id, r.token, r.tf) for r in registry.QUERIES["tsvector_parse"](spark, str(tmp_path)).collect()}
    words = {(3, "a"): 2, (3, "b"): 1, (99, "it"): 2, (99, "s"): 2, (100, "x"): 1, (250, "b"): 3, (250, "c"): 1, (10**6 + 1, "é"): 1, (10**6 + 1, "7"): 1}
    assert got == {(i, t, n) for (i, t), n in words.items()}


def test_neighbors_of_all_queries(spark):
    asked = {r.vec_id for r in registry.load(spark, SMALL, "embeddings").where("vec_id % 20 = 0").collect()}
    assert max(asked) > 100
    for name in ("knn_neighbors", "neighbor_jaccard", "ann_ivf"):
        assert {r.query_id for r in registry.QUERIES[name](spark, SMALL).select("query_id").collect()} == asked


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
