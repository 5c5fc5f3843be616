"""Hot keys, ties, repeated and null ids, the paths beyond a limit, and independent versions of what SQL can't express."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import bpe, files, huffman, jaccard, language, media, mixing, repetition, runtime, secret_scan, suffixes, sums, warc
from lodestone.llm.queries import vocabulary
from lodestone.llm.vocab import Vocabulary

from .test_operators import PATH, WORD, library, prose

TEXTS = "doc_id long, text string"


# Suffixes


def removed(rows):
    """Brute force of the suffix operator over (doc_id, bytes)."""
    n = Counter(p[k : k + 200] for _, p in rows for k in range(len(p) - 199))
    out = []
    for i, p in rows:
        gone = np.zeros(len(p) + 200, bool)
        for k in range(len(p) - 199):
            if n[p[k : k + 200]] > 1:
                gone[k : k + 200] = True
        gone = gone[: len(p)]
        out.append((i, len(p), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(p, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [100_000, 3])
@pytest.mark.parametrize("rounds", [2, 3])
def test_passage_in_all_documents(spark, monkeypatch, crowd, rounds):
    """One passage at any place of every document, periodic texts, and passages of 199 to 201 bytes; with crowded pairs salted."""
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes.sizes_of, "__defaults__", (rounds,))
    rng = np.random.default_rng(rounds)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    fresh = lambda n: " ".join(word() for _ in range(n))
    passage, edge = fresh(60), [fresh(60)[:n] for n in (199, 200, 201)]
    texts = [f"{fresh(int(rng.integers(0, 60)))} {passage[int(rng.integers(0, 30)) :]} {fresh(int(rng.integers(0, 60)))}" for _ in range(40)]
    texts += [f"{word()}{e}{word()}" for e in edge for _ in range(2)] + ["ab" * 300, "x" * 450, f"{passage}{passage}"]
    docs = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])]
    got = suffixes.digest(suffixes.deduplicate(spark.createDataFrame(docs, TEXTS).repartition(5)))
    assert sorted(map(tuple, got.collect()), key=str) == removed([(i, t.encode()) for i, t in docs])


def test_suffix_length_is_checked(spark):
    with pytest.raises(ValueError):
        suffixes.deduplicate(spark.createDataFrame([(1, "x")], TEXTS), length=4)


# Jaccard


def star(rng, n):
    """A text and n near copies of it, that aren't near each other's copies' copies."""
    base = prose(rng, 200, 5000).split()
    out = [" ".join(base)]
    for k in range(n):
        w = list(base)
        w[int(rng.integers(0, 200))] = f"x{k}"
        out.append(" ".join(w))
    return out


def test_hot_component_without_ids(spark, monkeypatch):
    """A large component, most rows without a doc_id or with the same one; broadcasts, then shuffles."""
    rng = np.random.default_rng(9)
    texts = star(rng, 60) + [prose(rng, 100, 5000) for _ in range(20)] + ["same text of five words"] * 30
    rows = [(None if k % 3 else 7 if k % 2 else k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, TEXTS).repartition(4)
    hub = min(i for i, _ in rows[:61] if i is not None)
    copies = min(i for i, _ in rows[81:] if i is not None)
    want = sorted([(i, len({tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)}), hub if k < 61 else copies if k > 80 else i) for k, (i, t) in enumerate(rows)], key=str)
    assert sorted(map(tuple, jaccard.link(docs).collect()), key=str) == want
    monkeypatch.setattr(jaccard, "TASK_SETS", 4)
    monkeypatch.setattr(jaccard, "small", lambda table: table)
    assert sorted(map(tuple, jaccard.link(docs).collect()), key=str) == want


@pytest.mark.parametrize("order", [1, -1])
def test_equal_sets_of_different_texts_keep_their_links(spark, order):
    """Texts with one set but other case, white space or order of repeats stand for one node; its links with near texts stay, whichever doc_id is the smallest."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(12):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
        same = [" ".join(words), " ".join(words).upper(), "  ".join(words), "\n".join(words) + " ", "\t".join(words)]
        rows += [*same, " ".join([*words[:-1], "other"]), " ".join([*words[:-1], "another"]).upper()]
    ids = [i // 7 * 7 + (i % 7 if order == 1 else 6 - i % 7) for i in range(len(rows))]
    docs = spark.createDataFrame(list(zip(ids, rows)), TEXTS).repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.link(docs).collect()}
    assert got == {i: i // 7 * 7 for i in ids}
    none = spark.createDataFrame([(None, rows[0]), (None, rows[1]), (None, rows[2]), (5, rows[5]), (4, rows[6])], TEXTS)
    assert sorted(r.component_id for r in jaccard.link(none).collect()) == [4] * 5


def test_trie_bounds_lose_nothing():
    rng = np.random.default_rng(1)
    base = rng.choice(4000, 300, replace=False)
    sets = [np.unique(np.concatenate((rng.choice(base, int(rng.integers(200, 300)), replace=False), rng.integers(0, 4000, int(rng.integers(0, 60)))))).astype(np.uint64) for _ in range(60)]
    tiers = np.zeros(jaccard.SKETCH, np.uint8)
    got = {frozenset(p) for p in jaccard.walk(sets, [True] * 60, [True] * 60, tiers, 4, 5)}
    want = {frozenset((i, j)) for i in range(60) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    assert got == want and want


# Shared parts


def test_hash_maps(spark):
    h = np.random.default_rng(2).integers(-(2**63), 2**63, 5000)
    bits = sums.bitmap(spark.createDataFrame([(int(x),) for x in h], "h long").repartition(3), "h")
    assert sums.marked(bits, h.view(np.uint64)).all() and sums.marked(bits, np.random.default_rng(3).integers(0, 2**64, 5000, dtype=np.uint64)).mean() < 0.2
    assert not sums.marked(sums.bitmap(spark.createDataFrame([], "h long"), "h"), h.view(np.uint64)).any()


def test_broadcast_by_bytes(spark):
    rows = spark.createDataFrame([(k, "x" * 1000, [1] * 100) for k in range(100)], "k int, s string, a array<int>")
    planned = lambda most: "BroadcastHashJoin" in rows.hint("shuffle_replicate_nl").join(runtime.small(rows.select("k", "s"), most), "k")._jdf.queryExecution().optimizedPlan().toString() or runtime.small(rows, most)._jdf.queryExecution().analyzed().toString().startswith("ResolvedHint")
    assert planned(1 << 20) and not planned(1000)


def test_local_copies_are_kept_apart(tmp_path, monkeypatch):
    """Two files of one name on a file system that isn't local."""
    from pyarrow import fs

    class Remote(fs.SubTreeFileSystem):
        pass

    for k in (1, 2):
        (tmp_path / f"lexicon-{k}").mkdir()
        (tmp_path / f"lexicon-{k}" / "lexicon.bin").write_text(str(k))
    monkeypatch.setattr(files, "at", lambda uri: (Remote(str(tmp_path), fs.LocalFileSystem()), uri.removeprefix("store://")))
    monkeypatch.setattr(files.tempfile, "gettempdir", lambda: str(tmp_path))
    assert [open(files.local_copy(f"store://lexicon-{k}/lexicon.bin")).read() for k in (1, 2, 1)] == ["1", "2", "1"]


def test_checkpoint_folder_is_asked_for(monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session(), "x")


# Mixing


def held(docs, plan):
    got = mixing.mix(docs, plan).selectExpr("doc_id", "mix_domain", "mix_lang", "mix_source", "mix_epoch", "mix_tokens").collect()
    con = duckdb.connect()
    frame = docs.select("doc_id", "text", "lang", "source").toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con.register("documents", frame)
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(mixing.mix_sql(plan)).fetchall(), key=str)
    return got


def test_weights_of_zero_and_hot_leaf(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 8)
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 150)) if k % 9 else None, " ".join(["w"] * int(rng.integers(0, 40))), ("en", "de", "fr", None)[int(rng.integers(0, 4))] if k % 3 else "en", "src1" if k % 3 == 0 else f"src{rng.integers(0, 12)}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    assert not [r for r in held(docs, mixing.Mix(weights={"domain": {"web": 0, "reference": 1}})) if r.mix_domain == "web"]
    some = held(docs, mixing.Mix(weights={"lang": {"en": 0}}, budget=80))
    assert some and not [r for r in some if r.mix_lang == "en"]
    assert not held(docs, mixing.Mix(weights={"domain": {"web": 0, "reference": 0}}))
    assert not held(docs, mixing.Mix(budget=0)) and held(docs, mixing.Mix(budget=500, epochs=3))


@pytest.mark.parametrize("wrong", [{"weight": -1}, {"budget": -1}, {"epochs": 0}, {"weights": {"lang": {"en": 0.5}}}, {"weights": {"nothing": {}}}])
def test_mix_is_validated(wrong):
    with pytest.raises(ValueError):
        mixing.Mix(**wrong)


# Repetition


def test_repetition_of_a_very_long_text(spark):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in rng.integers(0, 60, 30_000)]
    text = " ".join(words)
    r = repetition.repetition(spark.createDataFrame([(1, text)], TEXTS)).first()
    for k in range(5, 11):
        seen, cover = set(), np.zeros(len(words), bool)
        for j in range(len(words) - k + 1):
            g = tuple(words[j : j + k])
            if g in seen:
                cover[j : j + k] = True
            seen.add(g)
        assert r[f"chars_{k}"] == sum(len(w) for w, c in zip(words, cover) if c)
    assert r.n_words == 30_000 and r.word_chars == sum(map(len, words))


# Token files and vocabularies


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="pre_tokenizer"):
        Vocabulary(vocabulary("byte_bpe_50k.json"))


@pytest.mark.parametrize("most", [10**6, 50])
def test_remembered_words_change_no_id(most):
    """Also while words are forgotten, and after the texts have changed altogether."""
    rng, t, own = np.random.default_rng(8), library(), huffman.CachedLibrary(PATH, most)
    odd = ["it's 12,5 km — don't", "A.B,C!!d 3a4", "ẖ H̱ İ İ Σας", "<|endoftext|>X", "x\x85y\xa0z", "…word, café, naïve.", "'s 've'll '' ''s", ""]
    for step in range(6):
        alphabet = list("abcdeABC.,'!#19") if step < 3 else list("éüßñçΩж密.,'")
        texts = odd + [" ".join("".join(rng.choice(alphabet, int(rng.integers(1, 9)))) for _ in range(30)) for _ in range(30)]
        assert [np.frombuffer(x, own.kind).tolist() for x in own.encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_files_roll_over(spark, monkeypatch):
    monkeypatch.setattr(huffman, "FILE_IDS", 50)
    docs = spark.createDataFrame([(k, f"some text {k} {'x ' * k}") for k in range(60)], TEXTS).repartition(3)
    manifest = huffman.write(docs, PATH)
    rows = sorted(map(tuple, huffman.read_ids(manifest).collect()))
    t, start = library(), 0
    for (i, base, ids), (k, text) in zip(rows, sorted(map(tuple, docs.collect()))):
        want = t.encode(text, add_special_tokens=False).ids + [2]
        assert (i, base, ids) == (k, start, want)
        start += len(want)
    assert manifest.count() > 8 and len(rows) == 60


def test_bases_of_many_files(spark):
    rows = [(k, f"f{k}", 1, int(n)) for k, n in enumerate(np.random.default_rng(3).integers(0, 9, 50)) if n]
    got = sorted((r.path, r.base) for r in huffman.with_bases(spark.createDataFrame(rows, "file long, path string, docs long, ids long"), 7).collect())
    before, want = 0, []
    for _, path, _, n in rows:
        want.append((path, before))
        before += n
    assert got == sorted(want)


def test_large_vocabularies():
    assert [huffman.limit_for(n) for n in (49408, 1 << 16, 1 << 18, 1 << 22)] == [18, 18, 20, 24]
    with pytest.raises(ValueError):
        huffman.limit_for(1 << 23)
    ids = np.random.default_rng(1).integers(0, 300_000, 4000).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=300_000) + 1, huffman.limit_for(300_000))
    assert (huffman.decode_block(huffman.encode_block(ids, lengths, huffman.canonical(lengths)), huffman.decode_table(lengths)) == ids).all()


def test_repeated_ids_and_empty_lexicon(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, None)], TEXTS)
    uri = bpe.compile_lexicon(docs, PATH, most=0)
    assert sorted(len(r.ids) for r in bpe.encode(docs, PATH, uri).collect()) == [0, 1, 2, 2]


# Media


def test_formats_that_end_by_marks():
    zipped = b"PK\x03\x04" + b"z" * 40 + b"PK\x05\x06" + bytes(8) + struct.pack("<IIH", 20, 24, 3) + b"abc"
    pdf = b"%PDF-1.4 body startxref 9 %%EOF"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd" + b"\x01\xff\x00\x02\xff\xd0\x03\xff\xff\xd9"
    for value, kind in ((zipped, "application/zip"), (pdf, "application/pdf"), (jpeg, "image/jpeg")):
        assert media.sniff(b"xx" + value + b"yy") == [(kind, 2, len(value))] and media.sniff(value[:-4]) == []
    both = pdf + b" " + pdf.replace(b"startxref", b"none")
    assert media.sniff(both) == [("application/pdf", 0, len(pdf))]


def ogg_page(flags: int, body: bytes) -> bytes:
    head = b"OggS\0" + bytes([flags]) + bytes(8) + b"\1\0\0\0" + bytes(4)
    crc, tail = 0, bytes([1, len(body)]) + body
    for byte in head + bytes(4) + tail:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return head + struct.pack("<I", crc) + tail


def test_ogg_checksums():
    value = ogg_page(2, b"first") + ogg_page(0, b"more") + ogg_page(4, b"last")
    assert media.sniff(b"--" + value) == [("audio/ogg", 2, len(value))]
    assert media.sniff(value.replace(b"more", b"mora")) == []


def test_false_starts_are_cheap():
    for mark in (b"PK\x03\x04", b"%PDF-", b"\xff\xd8\xff\xda\x00\x02 "):
        start = time.time()
        assert media.sniff(mark * 100_000) == []
        assert time.time() - start < 8


def timed(run, value) -> float:
    start = time.perf_counter()
    run(value)
    return time.perf_counter() - start


def test_unended_gifs_are_cheap():
    """Many headers whose sub-blocks run on without an end, and many whose blocks do."""
    for tail in (b"GIF89a" + b"\x01" * 7 + b"!\xf9\x04" + b"x" * 4, b"GIF89a" + b"\x01" * 7 + b",\0\0\0\0\1\0\1\0\0\2\1a\0"):
        assert timed(media.sniff, tail * 60_000) < 12
    gif = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    assert media.sniff(gif * 3) == [("image/gif", k * len(gif), len(gif)) for k in range(3)]
    assert media.sniff(b"GIF89a\1\0\1\0\0\0\0!\xfe\1a\0;") == []  # no frame


def test_runs_of_token_starts_are_cheap():
    scan = secret_scan.Scanner(secret_scan.BASE_RULES + secret_scan.MORE_RULES).scan
    assert timed(lambda t: scan([t]), "eyJ" * 350_000 + ".eyJ") < 5 and timed(lambda t: scan([t]), "eyJ" * 350_000 + ".eyJabcdefghij." + "eyJ" * 3) < 5
    plain = re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
    rng, parts = np.random.default_rng(4), ["eyJ", "abcdefghij", ".", "-_", "x", " ", "eyJ0123456789", ".eyJ0123456789.", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, int(rng.integers(1, 14))))
        assert [(a, b) for k, a, b in scan([text])[0] if k == "jwt"] == [m.span() for m in plain.finditer(text)]


def test_very_long_words_are_merged():
    """A word of a million letters in some seconds, and long words as the library merges them."""
    from tokenizers import Tokenizer

    from lodestone.llm import vocab
    from lodestone.llm.queries import vocabulary

    path = vocabulary("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), vocab.Vocabulary(path)
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("etaoinshrdlucmfé"), n)) for n in (60, 95, 96, 97, 300, 4000)] + ["a" * 5000, "ab" * 2000, "".join(rng.choice(list("abcdefgh"), 1_000_000))]
    for word in words:
        start = time.perf_counter()
        ids = own.merge(word)
        assert time.perf_counter() - start < 20
        assert ids == library.encode(word, add_special_tokens=False).ids


def test_features_of_texts(spark):
    """Texts can hold whole media of formats that are written in ASCII; the offsets are those in the stored WAVE, 44 bytes in."""
    pdf = "%PDF-1.4 body startxref 9 %%EOF"
    texts = [None, "", "plain BM text RIFF", f"é {pdf} tail", pdf, f"{pdf}\n{pdf}", "%PDF- without an end", "GIF89a OggS PK\x03\x04"]
    docs = spark.createDataFrame(list(enumerate(texts)), TEXTS)
    for r in media.media_digest(media.store_texts(docs)).collect():
        raw = (texts[r.doc_id] or "").encode()
        size = max(64, -(-len(raw) // 64) * 64)
        at = [k for k in range(len(raw)) if raw.startswith(pdf.encode(), k)]
        want = ["application/octet-stream>audio/wav", f"audio/wav@0+{44 + size}", *(f"application/pdf@{44 + k}+{len(pdf)}" for k in at)]
        assert r.feature == ";".join(want) and (r.payload_bytes, r.media_bytes, r.n_bytes) == (size, size + 44, len(raw))


# Languages


@pytest.mark.parametrize("text, has", [("²", False), ("½ 12 ⅷ ①", False), ("́", False), ("", False), (None, False), ("1 ª", True), ("密", True), ("12a", True)])
def test_letters(text, has):
    assert language.has_letter(text) == has


def test_texts_without_letters_are_und(spark):
    rows = spark.createDataFrame([(1, "some words here", "en"), (2, "²½ ①", "en"), (3, "1 ª", None), (4, None, None)], TEXTS + ", lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(rows, language.train(rows)).collect()}
    assert got[2] == got[4] == ("und", 0.0) and got[1][0] == got[3][0] == "en"


def independent(counts, text, penalty=4.0):
    """The mixture of a text by plain loops: all sizes of set, expectation-maximisation over each n-gram."""
    raw = (" " + text.lower() + " ").encode()
    raw = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in raw)
    grams = Counter(raw[k : k + 3] for k in range(len(raw) - 2) if raw[k + 1] != 32)
    slot = lambda g: ((int.from_bytes(g, "big") * 2654435761) & 0xFFFFFFFF) >> 16
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + 0.1 * 65536 for x in langs}
    p = {g: [(counts[x][slot(g)] + 0.1) / total[x] for x in langs] for g in grams}
    n = sum(grams.values())

    def em(pi):
        for _ in range(12):
            new = [0.0] * len(langs)
            for g, c in grams.items():
                w = [a * b for a, b in zip(p[g], pi)]
                for k, v in enumerate(w):
                    new[k] += c * v / sum(w)
            pi = [v / n for v in new]
        return pi, sum(c * math.log(sum(a * b for a, b in zip(p[g], pi))) for g, c in grams.items())

    whole, _ = em([1 / len(langs)] * len(langs))
    order = sorted(range(len(langs)), key=lambda k: -whole[k])
    best, score = [float(k == order[0]) for k in range(len(langs))], sum(c * math.log(p[g][order[0]]) for g, c in grams.items())
    for size in range(2, len(langs) + 1):
        start = [max(whole[k], 1e-6) if k in order[:size] else 0.0 for k in range(len(langs))]
        pi, value = em([v / sum(start) for v in start])
        value -= penalty * 0.5 * (size - 1) * math.log(n)
        if value > score:
            best, score = pi, value
    return dict(zip(langs, best))


def test_mixture_against_plain_loops(spark):
    rng = np.random.default_rng(11)
    vocabulary_of = {g: ["".join(rng.choice(list(a), int(rng.integers(3, 7)))) for _ in range(40)] for g, a in (("aa", "abcdefghi"), ("bb", "ijklmnopqrs"), ("cc", "stuvwxyzé"))}
    say = lambda g, n: " ".join(rng.choice(vocabulary_of[g], n))
    rows = [(k, say(g, 80), g) for k, g in enumerate(("aa", "bb", "cc") * 20)]
    asked = [(1000, say("aa", 40) + " " + say("bb", 25), None), (1001, say("cc", 60), None), (1002, say("aa", 30) + " " + say("bb", 30) + " " + say("cc", 30), None), (1003, "Q", None)]
    table = spark.createDataFrame(rows + asked, TEXTS + ", lang string")
    trained = [(t, g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    counts = {g: Counter() for g in vocabulary_of}
    for t, g in trained:
        _, f, c = language.features([t])
        counts[g].update(dict(zip(f.tolist(), c.tolist())))
    model = language.train(table)
    assert model.langs == sorted(counts)
    for r in language.identify(table, model).where("doc_id >= 1000").collect():
        want = independent(counts, dict((i, t) for i, t, _ in asked)[r.doc_id])
        got = {x.split(":")[0]: float(x.split(":")[1]) for x in r.mixture.split(",")}
        assert r.lang_pred == max(want, key=want.get) and all(abs(got.get(g, 0) - v) < 2e-3 for g, v in want.items())


def test_held_out_documents_teach_nothing(spark):
    rows = [(k, f"{'abc def' if k % 2 else 'xyz uvw'} word{k}", "aa" if k % 2 else "bb") for k in range(60)]
    table = spark.createDataFrame(rows, TEXTS + ", lang string")
    lying = table.withColumn("lang", F.when(language.held_out(), "zz").otherwise(F.col("lang"))).withColumn("text", F.when(language.held_out(), "nonsense").otherwise(F.col("text")))
    a, b = language.train(table), language.train(lying)
    assert a.langs == b.langs == ["aa", "bb"] and (a.p == b.p).all() and table.where(language.held_out()).count() > 0


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out() & F.col("lang").isNotNull())
    r = found.agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("share")).first()
    assert r.n > 200 and r.share >= 0.99


# WARC


def test_archives_roll_over(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    monkeypatch.setattr(warc, "STRETCH_BYTES", 800)
    rng, out = np.random.default_rng(1), warc.ArchiveWriter(f"file://{tmp_path}/a", 0)
    payloads = [rng.bytes(int(n)) for n in rng.integers(0, 700, 40)]
    for k, p in enumerate(payloads):
        out.start(k, None, len(p), hashlib.sha1(p).hexdigest(), "response", None, None)
        out.chunk(p[:100])
        out.chunk(p[100:])
        out.end()
    out.close()
    assert len({path for path, *_ in out.done}) > 3 and len(out.done) > 8 and sum(n for *_, n in out.done) == 40
    back = [r for path, offset, length, _ in out.done for r in warc.read_records(files.read_at(path), offset, length)]
    assert [r[5] for r in back] == payloads and [r[0] for r in back] == list(range(40))
    whole = bytearray(open(f"{tmp_path}/a-00000.warc.gz", "rb").read())
    broken = out.done[0]
    first = payloads[0]
    bad = warc.ArchiveWriter(f"file://{tmp_path}/b", 0)
    bad.start(1, None, len(first) + 1, hashlib.sha1(first).hexdigest(), "response", None, None)
    bad.chunk(first)
    with pytest.raises(ValueError):
        bad.end()
    assert len(whole) >= broken[1] + broken[2]


def test_hot_payload_and_record_ids(spark, monkeypatch):
    rows = [(k % 70, f"http://x/{k}", "the same page" if k % 3 else f"page {k} " + "y" * (k * 7)) for k in range(200)] + [(5, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    seen = []
    stretches = warc.write(pages)
    got = sorted(map(tuple, warc.payloads(warc.read(stretches)).collect()), key=str)
    keep = {}
    for i, _, p in rows:
        keep[p] = max(keep.get(p, -1), i)
    want = [(i, len(p), warc.base32(hashlib.sha1(p.encode()).digest()), "response" if i == keep[p] else "revisit", None if i == keep[p] else keep[p]) for i, _, p in rows]
    assert got == sorted(want, key=str)
    for r in stretches.collect():
        stream = warc.Inflated(files.read_at(r.path), r.offset, r.length)
        while (head := stream.until(b"\r\n\r\n")) is not None:
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if x)
            seen.append(fields["WARC-Record-ID"])
            assert ("WARC-Refers-To-Target-URI" in fields) == (fields["WARC-Type"] == "revisit")
            stream.exactly(int(fields["Content-Length"]) + 4)
    assert len(seen) == len(set(seen)) == len(rows)
    monkeypatch.setattr(warc, "small", lambda table: table)
    assert sorted(map(tuple, warc.payloads(warc.read(warc.write(pages))).collect()), key=str) == got


# Pipeline


def test_stages_with_clashing_columns(spark):
    text = " ".join(f"word{k} and more" for k in range(60))
    docs = spark.createDataFrame([(1, text, "en", "src1", 5, 1, 2, 3), (1, "other words altogether in here", "en", "src1", 5, 1, 2, 3), (2, text, None, "src2", 5, 4, 5, 6)], "doc_id long, text string, lang string, source string, n_chars long, _id long, _row long, n long")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns and {r.lang for r in kept.collect()} == {"en"}
    assert corpus_pipeline.replace_secrets(spark, docs, "").columns == docs.columns


def test_words_of_the_base_rules():
    assert WORD.findall("a\x85b c\x0bd") == ["a\x85b", "c", "d"]
