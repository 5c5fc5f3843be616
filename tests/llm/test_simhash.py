"""SimHash against all pairs of documents."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import simhash
from lodestone.llm.queries import QUERIES
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def plain_fingerprint(text: str | None) -> int:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    some = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in some]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, fps):
    """Smallest id reachable, by a search from each row."""
    fps, out = np.array(fps, np.uint64), [None] * len(ids)
    for i in range(len(ids)):
        if out[i] is None:
            seen, todo = {i}, [i]
            while todo:
                for j in np.flatnonzero(np.bitwise_count(fps ^ fps[todo.pop()]) <= 4).tolist():
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            known = [ids[j] for j in seen if ids[j] is not None]
            for j in seen:
                out[j] = (min(known) if known else None,)
    return [o[0] for o in out]


def held(df, rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted((str(i), f"{fp:016x}", str(c)) for (i, _), fp, c in zip(rows, fps, plain_components([i for i, _ in rows], fps)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect()) == want


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, fp long, label string").repartition(4)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    texts = [None, "", " \t\n", "one", "One two", "one two three", "one two three four", "ONE two\tthree\nfour", "\x85 x y é É", "a b c d " * 300]
    for _ in range(6):
        base = [f"w{k}" for k in rng.integers(0, 500, 150)]
        for _ in range(25):
            words = list(base)
            for j in rng.integers(0, len(words), int(rng.integers(0, 5))):
                words[j] = f"e{rng.integers(0, 10**6)}"
            texts.append(" ".join(words))
    texts += texts[10:14]
    return [(k if k % 13 else None, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("shard", [3, 4096])
def test_all_pairs(spark, rows, shard, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", shard)  # crowded shards are cut into pieces
    monkeypatch.setattr(simhash, "FOREST", 50)
    held(simhash.link(frame(spark, rows)), rows)


def test_dense_and_chained_fingerprints(spark, monkeypatch):
    """Chains whose links are 4 bits each, a cloud around one value, and scattered values, in crowded shards of several components."""
    monkeypatch.setattr(simhash, "SHARD", 8)
    rng = np.random.default_rng(8)
    fps, x = [], 0
    for k in range(12):
        x ^= 0b1111 << (4 * k)
        fps.append(x)
    fps += [0xFFFF << 48 ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))]
    fps += [int(v) for v in rng.integers(0, 2**63, 80)] + [(7 << 61) ^ sum(1 << int(b) for b in rng.choice(50, 7, replace=False)) for _ in range(80)]
    df = spark.createDataFrame([(k, simhash.signed(f)) for k, f in enumerate(fps)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprint", lambda *a, **b: df)
    got = {r.doc_id: r.component_id for r in simhash.link(df).collect()}
    assert [got[k] for k in range(len(fps))] == plain_components(list(range(len(fps))), fps)


@pytest.mark.parametrize("radius,blocks", [(4, 5), (4, 6), (4, 8), (2, 4)])
def test_linked_fingerprints_share_a_shard(radius, blocks):
    rng, masks = np.random.default_rng(1), simhash.block_masks(blocks, radius)
    for _ in range(300):
        a = int(rng.integers(0, 2**63))
        b = a ^ sum(1 << int(i) for i in rng.choice(64, radius, replace=False))
        assert any(a & m == b & m for m in masks)


def test_forest_finds_all():
    rng = np.random.default_rng(4)
    values = np.unique(np.concatenate([rng.integers(0, 2**63, 300).astype(np.uint64), np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))]))
    rng.shuffle(values)
    group = np.sort(rng.integers(0, 4, len(values)))
    forest = simhash.Forest(values, group)
    who, node = forest.near(values, forest.root, 4)
    want = {(i, j) for i in range(len(values)) for j in np.flatnonzero((np.bitwise_count(values ^ values[i]) <= 4) & (group == group[i])).tolist()}
    assert set(zip(who.tolist(), node.tolist())) == want and len(who) == len(want)


def test_long_text_by_pieces(monkeypatch):
    text = " ".join(f"word{k % 977}" for k in range(3000)) + " " + "x" * 500 + " end of it"
    want = plain_fingerprint(text)
    for size in (1, 7, 100, 10**6):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert simhash.fingerprints([text, "a b", None]).tolist() == [want, plain_fingerprint("a b"), 0]


def test_empty(spark):
    assert simhash.link(frame(spark, [(1, "x")]).where("false")).count() == 0


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    held(QUERIES["op11_simhash_bktree"](spark, SMALL), [(r.doc_id, r.text) for r in docs])


def test_fingerprint_is_sparks_hash(spark):
    r = spark.range(1).select(F.xxhash64(F.lit("one two three four")).alias("h")).first()
    assert simhash.fingerprints(["one two three four"])[0] == r.h % (1 << 64)
