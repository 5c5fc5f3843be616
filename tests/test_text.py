from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vector as V


def test_signals():
    assert T.signals_of("포켓몬스터에서 가장 강한 포켓몬") == [("포켓몬스터", 0.812), ("포켓몬", 0.728), ("강한", 0.427), ("가장", 0.203)]
    assert T.signals_of("포켓몬 마스터") == [("포켓몬", 0.76), ("마스터", 0.538)]
    assert T.bm25_text_of("대한민국을 빛낸 100명의 위인들") == "100명 위인들 빛낸"
    assert [T.pool_of(q, 10, 0) for q in ("ARM", "ARM 아키텍처 설명", "가장 좋은 프로그래밍 언어")] == [120, 90, 60]


def test_terms():
    words = T.terms_of("김승민(래퍼) 관점에서 핵심 개념과 배경을 알려줘")
    assert {"김승민", "래퍼"} <= set(words) and "김승민래퍼" not in words


def test_snippet(spark):
    raw = "[[분류:게임]] [[링크|이름]] == 제목 == {{틀}} <b>x</b> [[파일:a.png]] [목차] || [1]"
    row = spark.createDataFrame([(raw,), ("[[분류:a]]",)], "s string").select(T.snippet_clean(F.col("s")).alias("s")).collect()
    assert [r.s for r in row] == ["이름 제목 x", T.EMPTY_SNIPPET]


def test_tags(spark):
    rows = spark.createDataFrame([("a, b ,,c,d",), (" , ",), (None,)], "c string").select(T.tags(F.col("c")).alias("t")).collect()
    assert [r.t for r in rows] == [["a", "b", "c"], ["Corpus"], ["Corpus"]]


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    got = rows.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.l2_distance(F.col("a"), F.col("b")).alias("l"), V.render(F.col("a"), 2).alias("r")).collect()
    assert [(r.c, r.l, r.r) for r in got] == [(None, 1.0, "[1.00,0.00]"), (1.0, 0.0, "[3.00,4.00]")]
    parsed = spark.createDataFrame([("[1, x,NaN,2]",), ("1,2",), ("[]",), (None,)], "s string").select(V.parse(F.col("s")).alias("v")).collect()
    assert [r.v for r in parsed] == [[1.0, 2.0], [], [], []]
