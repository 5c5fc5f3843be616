"""Changes of touched files only, back-fill by ranges, and percentiles by histograms."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import backfill, corpus, evaluate
from lodestone.operators.keyed import Keyed

ROWS = "id long, name string"


def rows_of(t):
    return sorted(tuple(r) for r in t.read().collect())


def ranges(t):
    e = t.entries()
    assert all(a.hi < b.lo for a, b in zip(e, e[1:]))
    return {r.path for r in e}


def test_changes_rewrite_touched_files_only(spark, tmp_path):
    rows = {k: f"n{k}" for k in range(0, 2000, 2)}
    frame = lambda d: spark.createDataFrame(list(d.items()), ROWS)
    t = Keyed(spark, f"file://{tmp_path}/t")
    t.create(frame(rows), 10)
    first = ranges(t)
    assert len(first) == 10 and rows_of(t) == sorted(rows.items())
    upsert = lambda own, source: corpus.upsert(own, source, "id", keep=[])
    change = {k: "new" for k in range(400, 420)}  # 1 % of the keys, of one range
    t.upsert(frame(change), upsert)
    rows |= change
    second = ranges(t)
    assert rows_of(t) == sorted(rows.items()) and len(first - second) == 1 and len(second - first) >= 1
    far = {-5: "before", 10**6: "after", 1001: "between"}
    t.upsert(frame(far), upsert)
    rows |= far
    third = ranges(t)
    assert rows_of(t) == sorted(rows.items()) and len(second - third) == 3
    absent = spark.createDataFrame([(k,) for k in range(601, 700, 2)], "id long")  # in the ranges, but no file has them
    assert t.holding(absent) == [] and t.change(absent, lambda own: corpus.delete(own, absent)) == t.version() == 2
    gone = spark.createDataFrame([(k,) for k in (600, 601, 602, 10**6)], "id long")
    t.change(gone, lambda own: corpus.delete(own, gone))
    rows = {k: v for k, v in rows.items() if k not in (600, 602, 10**6)}
    assert rows_of(t) == sorted(rows.items()) and len(third - ranges(t)) == 2
    whole = spark.createDataFrame([(k,) for k in rows], "id long")
    t.change(whole, lambda own: corpus.delete(own, whole))
    assert rows_of(t) == []
    t.upsert(frame({1: "a"}), upsert)
    assert rows_of(t) == [(1, "a")]


def test_backfill_by_ranges_goes_on(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 3).alias("id"), F.col("id").cast("string").alias("content"))
    path = f"file://{tmp_path}/rows"
    df.unionByName(spark.createDataFrame([(None, "none")], "id long, content string")).write.parquet(path)
    stored = spark.read.parquet(path)
    run, events, made = backfill.Run(spark, f"file://{tmp_path}/run", 40), [], []
    fill = lambda rows: rows.withColumn("n", F.length("content"))
    run.go(stored, fill, events.append, lambda: len(events) >= 1)
    assert 0 < len(run.left(stored)) < 40 and run.result(fill(stored).schema).count() < 1000

    def fails(rows):
        made.append(1)
        return fill(rows).withColumn("n", F.when(F.col("id") > 1500, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("n")))

    with pytest.raises(Exception, match="lost"):
        run.go(stored, fails)
    again = backfill.Run(spark, f"file://{tmp_path}/run", 40)
    out = again.go(stored, fill)
    assert again.left(stored) == [] and sorted((r.id, r.n) for r in out.collect()) == [(3 * k, len(str(k))) for k in range(1000)]
    assert again.go(stored, fails).count() == 1000 and len(made) == 2  # nothing is left; the schema only


@pytest.mark.parametrize("kind,values", [("double", "mixed"), ("long", "large"), ("double", "wide"), ("decimal(12,2)", "money")])
def test_percentiles_by_histograms(spark, kind, values):
    rng = np.random.default_rng(3)
    some = {
        "mixed": [*rng.normal(size=400).tolist(), *[0.5] * 300, float("inf"), float("-inf"), float("nan"), None],
        "large": [*(2**53 + rng.integers(0, 3, 200)).tolist(), *(-(2**40) + rng.integers(0, 9, 50)).tolist(), None],
        "wide": [*(10.0 ** rng.uniform(-20, 20, 60)).tolist(), *(-(10.0 ** rng.uniform(-20, 20, 30))).tolist(), 0.0, 1.7e308, -1.7e308],
        "money": [round(float(x), 2) for x in rng.normal(size=300) * 1000],
    }[values]
    groups = {"all": some, None: some[:57], "one": some[:1], "nulls": [None], "ties": some[:3] * 40}
    rows = [(g, v) for g, own in groups.items() for v in own]
    df = spark.createDataFrame([(g, None if v is None else str(v)) for g, v in rows], "g string, v string").select("g", F.col("v").cast(kind).alias("v")).repartition(5)
    for place, of in ((evaluate.p95_place, lambda n: max(1, int(n * 0.95))), (evaluate.floor_place(0.5), lambda n: min(n, int(n * 0.5) + 1))):
        got = {r.g: (r.n, str(float(r.v))) for r in evaluate.nearest_rank(df, "g", "v", place).collect()}
        want = {}
        for g, own in groups.items():
            known = sorted((v for v in own if v is not None), key=lambda v: (isinstance(v, float) and math.isnan(v), v))
            if known:
                want[g] = (len(known), str(float(known[of(len(known)) - 1])))
        assert got == want
