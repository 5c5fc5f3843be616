"""Spelling variants against all pairs of words."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import spelling
from lodestone.llm.queries import QUERIES
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, word string, n long, k string"


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, least=7):
    """{word: (form, root, n, n_near, form_n)}"""
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in total.items() if len(w) >= least and n >= 2}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [o for l in (-1, 0, 1) for o in by_length.get(len(w) + l, []) if one_edit(w, o)] for w in words}  # noqa: E741
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    letters = np.array(list("abcé"))
    pool = ["".join(rng.choice(letters, int(rng.integers(6, 10)))) for _ in range(300)]
    pool += ["".join(rng.choice(letters, int(rng.integers(30, 50)))) for _ in range(20)] + ["a" * k for k in range(6, 40)]
    pool += [w[:i] + "x" + w[i:] for w in pool[300:] for i in (0, len(w) // 2, len(w))] + [f"prefixed{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    weights = 1 / np.arange(1, len(pool) + 1)
    texts = [" ".join(rng.choice(pool, 200, p=weights / weights.sum())) for _ in range(60)]
    texts += [None, "", "  ", "Wörter WÖRTER wörtern Wörtern x×y÷zabcd", "AbCdEfGh abcdefgh-abcdefgi 12abcdefgi", "z" * 3000 + " " + "z" * 3001, "z" * 3000 + " " + "z" * 3001]
    out = [(k if k % 11 else None, t) for k, t in enumerate(texts)]
    return out + out[:3]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "k") for i, t in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("crowded", [0, 2, 16, 10**6])
def test_all_pairs(spark, rows, crowded, monkeypatch):
    monkeypatch.setattr(spelling, "CROWDED", crowded)  # each level of parts, and halves only
    assert got(spelling.variants(frame(spark, rows))) == plain(rows)


def test_small_tables_are_given_on(spark, rows, monkeypatch):
    words = {r.word: r.n for r in spelling.count_words(frame(spark, rows)).collect()}
    assert words == {w: v[2] for w, v in plain(rows).items()}
    assert sum(spelling.runs_of("abcdefgh " * 50, 1, re.compile("[a-z]{7,}"), 7).values()) == 50


def test_chain_of_forms(spark):
    """abcdefg has ten times abcdefgh's count, and that has ten times abcdefghi's."""
    texts = [(k, f"{a} {b}") for k, (a, b) in enumerate([("qqqqqqq", "rrrrrrrr")])]
    ids = iter(range(10, 10**6))
    for word, n in (("abcdefg", 220), ("abcdefgh", 21), ("abcdefghi", 2)):
        while n:
            k = next(ids)
            if zlib.crc32(f"{k}:{word}".encode()) % 31:
                texts.append((k, word))
                n -= 1
    found = got(spelling.variants(frame(spark, texts)))
    assert found["abcdefghi"] == ("abcdefgh", "abcdefg", 2, 1, 21) and found["abcdefg"] == (None, "abcdefg", 220, 1, None)


def test_empty(spark):
    assert got(spelling.variants(frame(spark, [(1, "x")]).where("false"))) == {}
    assert got(spelling.variants(frame(spark, [(1, None), (2, "short words here")]))) == {}


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert got(QUERIES["op13_spelling_variants"](spark, SMALL)) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_parts_cover_a_word():
    for n in range(1, 60):
        level, some = 1, [*spelling.parts(0, n, 0)]
        while True:
            assert some[0][0] == 0 and some[-1][1] == n and all(x[1] == y[0] for x, y in zip(some, some[1:]))
            more = [p for a, b in some for p in (spelling.parts(a, b, level) or [(a, b)])]
            if more == some:
                break
            some, level = more, level + 1
        assert n > 32 or max(b - a for a, b in some) <= 2
