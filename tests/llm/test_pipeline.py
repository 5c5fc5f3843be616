from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import mixing, secret_scan
from lodestone.llm.queries import vocabulary
from tests.conftest import SMALL


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    every, names = docs, docs.columns
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
    assert counts[0] == every.where("text rlike '\\\\p{L}'").count() and counts[1] < counts[0] == counts[2] + counts[0] - counts[1] and 0 < counts[3] <= counts[2] and counts[4] == counts[3]
    scanner = secret_scan.Scanner(secret_scan.BASE_RULES + secret_scan.MORE_RULES)
    assert not any(scanner.scan([r.text for r in spark.read.parquet(f"{tmp_path}/2").collect()]))


def test_language_rejects_junk(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    junk = ["qxzjv kwpqh zzxvb", "c2VjcmV0IGtleSBmb3IgdGVzdA==bGxxWq9vK", "deadbeef cafebabe 0xfeedface " * 20, "안녕하세요 세계 여러분", "Привет мир как дела", "12 34", "", None]
    first = docs.where("lang = 'fr'").orderBy("doc_id").first().asDict()
    extra = [first | {"doc_id": 10**6 + k, "text": t, "lang": None} for k, t in enumerate(junk)] + [first | {"doc_id": 10**7, "lang": None}, first | {"doc_id": None, "lang": None}]
    rows = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    got = {r.doc_id: r.asDict() for r in corpus_pipeline.identify_language(spark, rows, SMALL).collect()}
    want = {r.doc_id: r.asDict() for r in docs.collect()} | {10**7: first | {"doc_id": 10**7}, None: first | {"doc_id": None}}
    assert got == want
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") == first["doc_id"], "en").otherwise(F.col("lang")))
    assert {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, wrong, SMALL).collect()} == {r.doc_id: r.lang for r in docs.collect()}


def test_one_row_of_each_component(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one, two, three = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
    near = f"{one} end"
    texts = [(1, one), (None, one), (None, near), (None, two), (None, two), (None, f"{two} end"), (5, one), (5, three), (5, three), (7, f"{three} end"), (8, "x"), (8, "y"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], schema).repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()]
    pair = [g for g in got if g[0] is None and g[1]]
    assert len(pair) == 1 and pair[0][1] in (two, f"{two} end")
    assert sorted((g for g in got if g not in pair), key=str) == sorted([(1, one), (5, three), (8, "x"), (8, "y"), (None, None)], key=str)


def test_run_matches_stages(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() == out.select("doc_id").distinct().count() > 0


def test_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def brute_force(rows):
    """(doc_id, n_tokens, ids) of what the pipeline makes of (doc_id, text, lang, source, n_chars)."""
    grams = lambda t: [w[j : j + 3] for w in (f" {w} " for w in re.findall(r"[a-z\x80-\U0010ffff]+", t.lower())) for j in range(len(w) - 2)]
    counts, letters = {}, Counter()
    for _, t, lang, *_ in rows:
        if t and lang:
            counts.setdefault(lang, Counter()).update(grams(t))
            letters.update(t.lower())
    total = sum(letters.values())
    kept = []
    for i, t, _, source, n in rows:
        g = grams(t or "")
        likely = {k: sum(math.log((c[x] + 0.1) / (sum(c.values()) + 6553.6)) for x in g) for k, c in counts.items()}
        best = counts[max(likely, key=likely.get)] if g else {}
        alone = {x: sum(math.log((letters[y] / total + 1 / 155) / 2) for y in x) for x in g}
        if g and sum(max(-2.0, math.log((best[x] + 0.1) / (sum(best.values()) + 6553.6)) - alone[x]) for x in g) > 0:
            kept.append((i, t, max(likely, key=likely.get), source, n))
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for w in (r[1].lower().split() for r in kept)]
    group = list(range(len(kept)))
    for x in range(len(kept)):
        for y in range(x):
            if len(sets[x] & sets[y]) * 5 >= len(sets[x] | sets[y]) * 4:
                group = [group[y] if g == group[x] else g for g in group]
    first = {}
    for g, r in sorted(zip(group, kept), key=lambda gr: (gr[1][0] is None, gr[1][0] or 0)):
        first.setdefault(g, r)
    rules = secret_scan.BASE_RULES + secret_scan.MORE_RULES
    clean = []
    for i, t, lang, source, _ in first.values():
        spans = sorted((m.start(), k, m.end()) for k, r in enumerate(rules) for m in secret_scan.matches(r, r.compiled(), t))
        t = secret_scan.redact(t, [(k, a, b) for a, k, b in spans])
        clean.append((i, t, lang, source))
    con = duckdb.connect()
    frame = pd.DataFrame(clean, columns=["doc_id", "text", "lang", "source"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con.register("documents", frame)
    chosen = {(r[0], r[-1]) for r in con.execute(mixing.mix_sql(corpus_pipeline.MIX)).fetchall()}
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    ids = [(i, library.encode(t, add_special_tokens=False).ids) for i, t, *_ in clean if (i, len(t.split())) in chosen]
    return sorted([(i, len(x), x) for i, x in ids], key=str), len(kept), len(clean)


def test_run_matches_brute_force(spark, tmp_path):
    rng, rows = np.random.default_rng(5), []
    words = {g: ["".join(rng.choice(list(a), int(rng.integers(3, 8)))) for _ in range(80)] for g, a in (("en", "thensroa"), ("de", "dieruckgw"), ("fr", "lajxpovmq"))}
    for k in range(45):
        lang = ("en", "de", "fr")[k % 3]
        text = " ".join(rng.choice(words[lang], 240 + k))
        rows.append((k, text, None if k % 7 == 0 else lang, None if k % 11 == 0 else f"src{k % 10}", len(text)))
    extra = [rows[3], rows[3], (100, rows[4][1], "de", "src1", 1), (101, f"{rows[8][1]} {words['fr'][0]}", "en", "src2", 1), (None, rows[5][1], "fr", "src3", 1)]
    extra += [(12, " ".join(rng.choice(words["de"], 97)), "de", "src1", 1), (None, " ".join(rng.choice(words["en"], 98)), None, "src9", 1)]
    extra += [(200 + k, f"{' '.join(rng.choice(words['en'], 100 + k))} AKIAABCDEFGHIJKLMNO{k}", "en", "src2", 1) for k in range(2)]
    extra += [(300, "hwvhw khxtw vhtxwk tgxhvt", None, "src1", 1), (301, "", "en", "src1", 0), (302, None, "en", "src1", None), (303, "12 34", None, None, 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows + extra, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want, kept, clean = brute_force(rows + extra)
    assert kept == len(rows + extra) - 4 and clean == kept - 5 and 0 < len(want) < clean
    assert sorted(((r.doc_id, r.n_tokens, list(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == want
