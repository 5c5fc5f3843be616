"""Stems and pieces with positions, analysers, and vectors learned from terms."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import segmentation, stemming
from lodestone.functions import text as T
from lodestone.functions.analysers import Analyser
from lodestone.operators import evaluate
from lodestone.operators.latent import Latent
from lodestone.operators.stored import Index
from lodestone.plans import inputs, registry, search_queries

from .conftest import SMALL

# Pairs of the algorithm's published vocabulary.
PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid
consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu
conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc
constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel
kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive
knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
running run happy happi by by say say flies fli dies die generate generat generic generic communism communism hopping hop hoping hope skies sky news news proceed proceed relational relat""".split()


def test_published_pairs():
    wrong = [(w, s, stemming.stem(w)) for w, s in zip(PAIRS[::2], PAIRS[1::2]) if stemming.stem(w) != s]
    assert wrong == []


@pytest.mark.parametrize("word,want", [("", ""), ("a", "a"), ("ab", "ab"), ("été", "été"), ("포켓몬", "포켓몬"), ("'tis", "tis"), ("y", "y"), ("sss", "sss"), ("ing", "ing"), ("123", "123")])
def test_odd_words(word, want):
    assert stemming.stem(word) == want


def test_stems_with_positions(spark):
    docs = spark.createDataFrame([(1, "The runner runs, running the RUN."), (2, None), (3, ""), (4, "the of and"), (5, "run run")], "id long, text string")
    rows = {(r.id, r.stem): (r.positions, r.tf) for r in stemming.stems(docs, T.tokens(F.col("text"))).collect()}
    assert rows == {(1, "runner"): ([2], 1), (1, "run"): ([3, 4, 6], 3), (5, "run"): ([1, 2], 2)}
    assert stemming.query_stems("the Running of runs") == ["run"]


def test_stemmed_words_against_plain(spark):
    want = {}
    for r in registry.load(spark, SMALL, "documents").collect():
        for k, w in enumerate(T.words_of(r.text or ""), 1):
            if w not in stemming.STOP_WORDS:
                want.setdefault((r.doc_id, stemming.stem(w)), []).append(str(k))
    assert {(r.id, r.stem): r.positions for r in registry.QUERIES["stemmed_words"](spark, SMALL).collect()} == {k: ",".join(v) for k, v in want.items()}


def test_latent_vectors_find_planted_copies(spark, tmp_path):
    rng = np.random.default_rng(8)
    topics = [[f"t{t}w{k}" for k in range(40)] for t in range(12)]
    docs = [[str(w) for w in rng.choice(topics[k % 12] + [f"c{j}" for j in range(60)], 80)] for k in range(300)]
    copies = []
    for k in range(0, 300, 5):
        own = list(docs[k])
        for j in rng.integers(0, 80, 6):
            own[j] = f"c{rng.integers(0, 60)}"
        copies.append((1000 + k, own))
    rows = [*enumerate(docs), *copies, (5000, []), (5001, None), (5002, ["never seen twice"])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(4)
    model = Latent(spark, f"file://{tmp_path}/latent").fit(df, dim=32)
    v = model.vectors()
    assert v.count() == len(rows) and {r.id for r in v.where("embedding IS NULL").collect()} == {5000, 5001, 5002}
    found = evaluate.neighbors(v, v.where("id >= 1000 AND id < 5000"), 1).collect()
    assert len(found) == 60 and sum(r.id == r.query_id - 1000 for r in found) >= 54
    same = {r.id: np.array(r.embedding) for r in v.where("id < 3").collect()}
    for k in range(3):
        assert np.allclose(model.embed(" ".join(docs[k])), same[k], atol=1e-5)
    assert model.embed("unknown words") is None
    # the leading singular values' share is kept: reconstruction as good as the exact decomposition's
    terms = model.model()[0]
    a = np.zeros((len(rows), len(terms)))
    for i, r in enumerate(model.rows.collect()):
        a[i, r.codes] = r.weights
    exact = (np.linalg.svd(a, compute_uv=False)[:32] ** 2).sum()
    assert ((a @ model.model()[2]) ** 2).sum() >= 0.97 * exact
    none = Latent(spark, f"file://{tmp_path}/none").fit(df.where("false"))
    assert none.vectors().count() == 0 and none.embed("a") is None


SYLLABLES = [chr(0xAC00 + 131 * k) for k in range(80)]
ENDINGS = ["은", "는", "을", "에서", "으로"]


def planted(n=160):
    rng = np.random.default_rng(4)
    roots = list(dict.fromkeys("".join(rng.choice(SYLLABLES, rng.integers(2, 5))) for _ in range(n)))
    return roots, [(k, " ".join(str(rng.choice(roots)) + str(rng.choice(ENDINGS)) for _ in range(25))) for k in range(200)]


def test_lexicon_finds_planted_endings(spark):
    roots, rows = planted()
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "latin words 12"), rows[0]], "id long, text string")
    tokens = T.tokens(F.col("text"))
    lexicon = segmentation.learn(docs, tokens)
    right = [lexicon.cut(r + e) == [r, e] for r in roots for e in ENDINGS]
    assert np.mean(right) > 0.95
    assert lexicon.cut("뷁쮏에서") == ["뷁쮏", "에서"]  # a root never seen
    assert lexicon.cut("") == []
    again = segmentation.learn(docs.repartition(3), tokens)  # no order of rows, no repeated row counts
    assert again == lexicon == segmentation.Lexicon.stored(lexicon.frame(spark).repartition(3))
    none = segmentation.learn(docs.where("id > 901"), tokens)
    assert none.costs == {} and none.cut("가나다") == ["가나다"]
    with pytest.raises(ValueError):
        segmentation.learn(docs, tokens, size=0)


def test_path_is_the_cheapest():
    """Against all ways to cut short words."""
    import itertools

    lexicon = segmentation.Lexicon({"a": 2.0, "ab": 2.5, "b": 1.5, "abc": 6.0, "ca": 2.2}, 3.0, 0.9)

    def cost(pieces, known):
        return sum(lexicon.costs.get(p, np.inf) if k else lexicon.opening + lexicon.letter * len(p) for p, k in zip(pieces, known))

    for n in range(1, 7):
        for word in map("".join, itertools.product("abc", repeat=n)):
            ways = []
            for cuts in itertools.product([0, 1], repeat=n - 1):
                at = [0, *[k + 1 for k, c in enumerate(cuts) if c], n]
                pieces = [word[i:j] for i, j in zip(at, at[1:])]
                ways += [cost(pieces, known) for known in itertools.product([True, False], repeat=len(pieces))]
            path = lexicon.path(word)
            assert "".join(word[a:b] for a, b, _ in path) == word
            assert abs(cost([word[a:b] for a, b, _ in path], [k for _, _, k in path]) - min(ways)) < 1e-9


def test_long_words_are_cut_in_linear_time():
    lexicon = segmentation.Lexicon({"가나": 1.0}, 3.0, 0.9)
    start = time.time()
    assert len(lexicon.cut("가나" * 200_000)) == 200_000
    assert time.time() - start < 20


def test_analysers_of_languages(spark, tmp_path):
    roots, rows = planted()
    lexicon = segmentation.learn(spark.createDataFrame(rows, "id long, text string"), T.tokens(F.col("text")))
    root = next(r for r in roots if all(lexicon.cut(r + e) == [r, e] for e in ENDINGS))
    docs = spark.createDataFrame([(1, f"{root}은 Running"), (2, f"{root}에서"), (3, None), (4, ""), (5, "running the runs"), (6, "run")], "id long, content string")
    korean, english, simple = Analyser("korean", lexicon), Analyser("english"), Analyser("simple")
    assert korean.query(f"{root}을 {root}으로") == [root]
    assert {r.id: r.tokens for r in korean.analysed(docs, "t").collect()} == {1: [root, "running"], 2: [root], 3: [], 4: [], 5: ["running", "the", "runs"], 6: ["run"]}
    assert {(r.id, r.term): r.positions for r in korean.positions(docs.where("id < 4")).collect()} == {(1, root): [1], (1, "running"): [3], (2, root): [1]}
    assert [r.len for r in english.analysed(docs, "t").orderBy("id").collect()][4] == 1
    index = Index(spark, f"file://{tmp_path}/korean").build(korean.analysed(docs, "t"))
    assert {r.id for r in index.matching(korean.query(f"{root}으로"), "t").collect()} == {1, 2}
    stems = Index(spark, f"file://{tmp_path}/english").build(english.analysed(docs, "t"))
    assert {r.id for r in stems.matching(english.query("runs"), "t").collect()} == {1, 5, 6}
    # positions count the words passed over: "running the runs" is run, two places on run
    assert {r.id: r.n for r in english.phrase(docs, "run a run").collect()} == {5: 1}
    assert english.phrase(docs, "run runs").count() == 0 and english.phrase(docs, "the").count() == 0
    assert {r.id: r.n for r in simple.phrase(docs, "the runs").collect()} == {5: 1}
    for wrong in (lambda: Analyser("korean"), lambda: Analyser("english", lexicon), lambda: Analyser("latin")):
        with pytest.raises(ValueError):
            wrong()


def test_stemmed_search_against_plain(spark):
    words = {}
    for r in registry.load(spark, SMALL, "documents").collect():
        words[r.doc_id] = [stemming.stem(w) for w in T.words_of(r.text or "") if w not in stemming.STOP_WORDS]
    asked = stemming.query_stems(search_queries.STEMMED)
    n, avg = len(words), sum(len(set(w)) for w in words.values()) / len(words)
    df = {q: sum(q in w for w in words.values()) for q in asked}
    want = {}
    for i, w in words.items():
        if set(w) & set(asked):
            want[i] = round(sum(np.log(1 + (n - df[q] + 0.5) / (df[q] + 0.5)) * w.count(q) * 2.2 / (w.count(q) + 1.2 * (0.25 + 0.75 * len(set(w)) / avg)) for q in asked if q in w), 6)
    want = sorted(want.items(), key=lambda x: (-x[1], -x[0]))[:10]
    got = [(r.id, r.score) for r in registry.QUERIES["stemmed_search"](spark, SMALL).collect()]
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=2e-6)


def test_segmented_words_against_plain(spark):
    lexicon = inputs.lexicon(spark, SMALL)
    want = {}
    for r in registry.load(spark, SMALL, "documents").collect():
        k = 0
        for w in T.words_of(r.text or ""):
            for p in lexicon.cut(w) if w.isalpha() else [w]:
                k += 1
                want.setdefault((r.doc_id, p), []).append(str(k))
    assert {(r.id, r.term): r.positions for r in registry.QUERIES["segmented_words"](spark, SMALL).collect()} == {k: ",".join(v) for k, v in want.items()}


def test_terms_of_a_batch_by_distinct_words():
    """Terms with places as a plain loop gives them, each distinct word analysed once, and batches cut by their words."""
    import pyarrow as pa

    from lodestone.functions.analysers import Placed, cut

    rng = np.random.default_rng(3)
    rows = [None, [], ["stop"], *([f"w{x}" if x else "stop" for x in rng.integers(0, 9, n)] for n in rng.integers(0, 40, 30)), ["ab"] * 200]
    calls = []

    def terms(words):
        calls.extend(words)
        return [t for w in words for t in ([None] if w == "stop" else [w[:1], None, w[1:]] if w > "w4" else [w])]

    want = []
    for i, words in enumerate(rows):
        at = {}
        for k, t in enumerate(terms(words or ()), 1):
            if t:
                at.setdefault(t, []).append(k)
        want += [(i, t, p, len(p)) for t, p in at.items()]
    calls.clear()
    b = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["tokens"])
    row, term, places, n = Placed(b.column(0), terms).groups()
    assert sorted(zip(row.tolist(), term.to_pylist(), places.to_pylist(), n.tolist())) == sorted(want)
    assert len(calls) == len(set(calls))
    parts = list(cut([b, b.slice(0, 0)], most=50))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == rows
    assert all(p.num_rows == 1 or sum(map(len, filter(None, p.column(0).to_pylist()))) <= 50 for p in parts) and len(parts) > 5


def test_latent_vectors_of_bounded_products(spark):
    """A product's rows of the basis take 32 MB at most, and the query writes a vector of each document."""
    from lodestone.operators import latent

    assert latent.ENTRIES * (latent.DIM + latent.MORE) * 8 <= 1 << 25
    rows = registry.QUERIES["latent_vectors"](spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert all(len(r.v.split(",")) == latent.DIM and all(len(x) == 5 for x in r.v.split(",")) for r in rows if r.v)


def test_lattice_looks_up_few_pieces():
    """Paths as a plain search over all pieces gives them, with fewer look-ups."""
    import math

    class Counted(dict):
        looked = 0

        def get(self, *a):
            Counted.looked += 1
            return super().get(*a)

    rng = np.random.default_rng(6)
    word = lambda most: "".join(rng.choice(list("abcd"), int(rng.integers(1, most))))
    lexicon = segmentation.Lexicon(Counted({word(7): float(rng.integers(1, 6)) for _ in range(40)}), 3.0, 1.0)

    def plain(w):
        cost, back, inside, since = [0.0] * (len(w) + 1), [None] * (len(w) + 1), math.inf, 0
        for i in range(1, len(w) + 1):
            if cost[i - 1] + 3.0 <= inside:
                inside, since = cost[i - 1] + 3.0, i - 1
            inside += 1.0
            own = [(cost[j] + dict.get(lexicon.costs, w[j:i]), j) for j in range(max(0, i - 8), i) if w[j:i] in lexicon.costs]
            least = min(own, default=(math.inf, 0))
            cost[i], back[i] = (least[0], (least[1], True)) if least[0] <= inside else (inside, (since, False))
        out, i = [], len(w)
        while i:
            j, known = back[i]
            out.append((j, i, known))
            i = j
        return out[::-1]

    words = [word(20) for _ in range(500)]
    assert [lexicon.path(w) for w in words] == [plain(w) for w in words]
    assert Counted.looked < 0.6 * sum(min(i, 8) for w in words for i in range(1, len(w) + 1))
