"""Language identification as inference of a mixture.

Training counts hashed byte trigrams of letters per language over every labelled training document
(a map-side sum per task, then one sum per language and feature). A document is a mixture of
languages: expectation-maximisation estimates the proportions from the likelihoods of its n-grams,
once for each number of languages (the most probable ones so far), and the penalised likelihood
(Bayesian information criterion times `penalty`) picks the set.

Defined results: a null text, or one without letters, is `und` with score 0 and no mixture; null
labels and null ids never train; repeated rows train as often as they occur and each get a row; ties
go to the language that sorts first; without any training row every document is `und`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import BATCH_BYTES, cut, documents, map_texts

#: Hashed features; a power of 2. The model is features times languages and nothing else is broadcast.
FEATURES = 1 << 16
#: More languages than this are an error, not a cut.
MOST_LANGUAGES = 256
#: ASCII letters stay, bytes of other characters stay, the rest is a space.
KEEP = np.where(np.isin(np.arange(256), np.r_[97:123]) | (np.arange(256) >= 128), np.arange(256), 32).astype(np.uint8)
STEPS = 12
SMOOTH = 0.1
#: Nats by which an n-gram counts against its text at most, so that a key or a name doesn't outweigh the words of a short text.
MOST_AGAINST = 2.0


def has_letter(text: str | None) -> bool:
    """Whether a character of one of Unicode's letter categories is in the text; numerals, superscripts and marks aren't letters."""
    return bool(text) and any(map(str.isalpha, text))


def features(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of a batch in order, with counts."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(x) + 2 for x in raw], np.int64)
    data = KEEP[np.frombuffer(b" " + b"  ".join(raw) + b" ", np.uint8)] if raw else np.zeros(0, np.uint8)
    owner = np.repeat(np.arange(len(raw), dtype=np.uint64), sizes)
    d = data.astype(np.uint32)
    gram = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
    keep = (data[1:-1] != 32) & (owner[:-2] == owner[2:])
    code = ((gram[keep] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint64)
    key, count = np.unique((owner[:-2][keep] << np.uint64(16)) | code, return_counts=True)
    return (key >> np.uint64(16)).astype(np.int64), (key & np.uint64(FEATURES - 1)).astype(np.int64), count


def letters(texts) -> np.ndarray:
    """How often each kept byte is in the texts."""
    data = "".join(t or "" for t in texts).lower().encode("utf-8", "replace")
    return np.bincount(KEEP[np.frombuffer(data, np.uint8)], minlength=256)


def background(counts: np.ndarray) -> np.ndarray:
    """Log-probability of each feature where letters follow each other independently: half as often as counted, half alike, so letters never seen have a chance."""
    alphabet = np.unique(KEEP)
    u = np.where(np.isin(np.arange(256), alphabet), 1 / len(alphabet), 0)
    if counts.sum():
        u = (u + counts / counts.sum()) / 2
    q, b = np.zeros(FEATURES), alphabet.astype(np.uint32)
    middle = b[b != 32]
    pairs, weight = (middle[:, None] << np.uint32(8)) | b, u[middle][:, None] * u[b]
    for x in b:
        code = (((x << np.uint32(16)) | pairs) * np.uint32(2654435761)) >> np.uint32(16)
        q += np.bincount(code.ravel(), (u[x] * weight).ravel(), FEATURES)
    return np.log(np.maximum(q / q.sum(), 1e-300))


def count_features(df: DataFrame) -> DataFrame:
    """lang, feature, n over all rows of (lang, text); kept bytes follow the features."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in cut(batches):
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for lang in set(langs):
                own = [t for g, t in zip(langs, texts) if g == lang]
                _, f, n = features(own)
                total = sums.setdefault(lang, np.zeros(FEATURES + 256, np.int64))
                total[:FEATURES] += np.bincount(f, n, FEATURES).astype(np.int64)
                total[FEATURES:] += letters(own)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "feature", "n"])

    return df.mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, langs, counts: np.ndarray):
        self.langs = list(langs)
        if len(self.langs) > MOST_LANGUAGES:
            raise ValueError(f"{len(self.langs)} languages; at most {MOST_LANGUAGES} are supported")
        counts, seen = counts[:, :FEATURES], counts[:, FEATURES:].sum(0)
        self.background = background(seen if len(seen) else np.zeros(256))
        p = (counts + SMOOTH) / (counts + SMOOTH).sum(1, keepdims=True)
        self.p = np.ascontiguousarray(p.T.astype(np.float32))  # by feature, then language

    @classmethod
    def fit(cls, counted: DataFrame) -> Model:
        """counted has a row per language and feature at most, so the size collected is bounded."""
        t = counted.toArrow()
        names = t["lang"].to_pylist()
        langs = sorted(set(names))
        place = {g: k for k, g in enumerate(langs)}
        counts = np.zeros((len(langs), FEATURES + 256))
        counts[np.fromiter((place[g] for g in names), np.int64, len(names)), t["feature"].to_numpy().astype(np.int64)] = t["n"].to_numpy()
        return cls(langs, counts)

    def infer(self, texts, penalty: float = 4.0):
        """Per text its language proportions after selection (rows of zeros where there are no letters)."""
        return self.judge(texts, penalty)[0]

    def judge(self, texts, penalty: float = 4.0):
        """What infer gives, and per text by how much an n-gram is likelier under the languages than under the background (-inf where there are no letters); one n-gram counts MOST_AGAINST against its text at most."""
        m, k = len(texts), len(self.langs)
        best, margin = np.zeros((m, k)), np.full(m, -np.inf)
        if not k or not m:
            return best, margin
        text, feature, count = features(texts)
        if not len(text):
            return best, margin
        has, first = np.unique(text, return_index=True)
        p, c = self.p[feature], count.astype(np.float32)
        whole, value = expect(p, c, first, np.full((len(has), k), 1 / k))
        top = whole.argmax(1)
        bounds = np.append(first, len(c))
        n = np.add.reduceat(c, first)
        over = np.log((p * whole.astype(np.float32)[np.repeat(np.arange(len(has)), np.diff(bounds))]).sum(1).astype(np.float64)) - self.background[feature]
        margin[has] = np.add.reduceat(c * np.maximum(over, -MOST_AGAINST), first) / n
        one = np.add.reduceat(c * np.log(p[np.arange(len(c)), np.repeat(top, np.diff(bounds))].astype(np.float64)), first)
        chosen = np.zeros_like(whole)
        chosen[np.arange(len(has)), top] = 1
        most = limit(p, c, first, whole, value)
        more = np.flatnonzero(most - one > penalty * 0.5 * np.log(n))
        if len(more):
            rows = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in more])
            start = np.concatenate(([0], np.cumsum(np.diff(bounds)[more])[:-1]))
            chosen[more] = select(p[rows], c[rows], start, whole[more], one[more], most[more], penalty)
        best[has] = chosen
        return best, margin


def expect(p: np.ndarray, c: np.ndarray, first: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for all documents of a batch: proportions and log-likelihood. p: entry by language; first: each document's first entry."""
    seg = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(c))))
    n = np.add.reduceat(c, first)[:, None]
    pi = pi.astype(np.float32)
    for _ in range(STEPS):
        w = p * pi[seg]
        w *= (c / w.sum(1))[:, None]
        pi = np.add.reduceat(w, first) / n
        pi /= pi.sum(1, keepdims=True)
    return pi.astype(np.float64), np.add.reduceat(c * np.log((p * pi[seg]).sum(1).astype(np.float64)), first)


def limit(p, c, first, pi, value) -> np.ndarray:
    """What no proportions exceed: log-likelihood is concave, so it gains at most the largest component of the gradient, less n, over its value at pi. Rounding of single floats is allowed for."""
    seg = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(c))))
    n, at = np.add.reduceat(c, first), p.astype(np.float64)
    slope = np.add.reduceat(at * (c / (at * pi[seg]).sum(1))[:, None], first)
    return value + np.maximum(slope.max(1) - n, 0) + 1e-6 * n


def select(p, c, first, whole, one, most, penalty: float) -> np.ndarray:
    """The proportions of the set of languages with the best penalised likelihood; sets are the most probable ones, from one up.

    Each document tries every size whose penalty leaves its limit (most) above its best so far."""
    k = whole.shape[1]
    rank = np.argsort(np.argsort(-whole, 1, kind="stable"), 1, kind="stable")
    chosen, score, n = np.where(rank < 1, 1.0, 0.0), one.copy(), np.add.reduceat(c, first)
    bounds = np.append(first, len(c))
    for size in range(2, k + 1):
        cost = penalty * 0.5 * (size - 1) * np.log(n)
        open_ = np.flatnonzero(most - cost > score)  # costs grow with size, so what is closed stays so
        if not len(open_):
            break
        rows = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in open_])
        at = np.concatenate(([0], np.cumsum(np.diff(bounds)[open_])[:-1]))
        start = np.where(rank[open_] < size, np.maximum(whole[open_], 1e-6), 0)
        pi, value = expect(p[rows], c[rows], at, start / start.sum(1, keepdims=True))
        value = value - cost[open_]
        better = value > score[open_]
        score[open_[better]], chosen[open_[better]] = value[better], pi[better]
    return chosen


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves the remainder 2 by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from text and lang of the rows that aren't held out."""
    rows = documents(df, id_col, text_col, lang_col).where(F.col(lang_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    return Model.fit(count_features(rows.select(F.col(lang_col).cast("string").alias("lang"), "text")))


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 4.0) -> DataFrame:
    """doc_id, lang_pred, score (the proportion of lang_pred) and mixture (lang:proportion by proportion) of every text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(rows):
        langs, texts = shared.value.langs, rows["text"]
        pi = shared.value.infer(texts, penalty)
        known = np.array([has_letter(t) for t in texts], bool) & (pi.sum(1) > 0) if langs else np.zeros(len(texts), bool)
        top = pi.argmax(1) if langs else np.zeros(len(texts), int)
        order = np.argsort(-pi, 1, kind="stable") if langs else None
        return {
            "doc_id": rows["doc_id"],
            "lang_pred": [langs[k] if ok else "und" for k, ok in zip(top, known)],
            "score": [min(1.0, float(round(pi[i, k], 6))) if ok else 0.0 for i, (k, ok) in enumerate(zip(top, known))],
            "mixture": [",".join(f"{langs[j]}:{pi[i, j]:.4f}" for j in order[i] if pi[i, j] > 5e-5) if ok else "" for i, ok in enumerate(known)],
        }

    return map_texts(documents(df, id_col, text_col), run, "doc_id long, lang_pred string, score double, mixture string")


def label(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", penalty: float = 4.0, least: float = 0.0) -> DataFrame:
    """The rows whose n-grams are likelier under the languages than under the background, by more than `least` an n-gram, with the predicted language in lang_col."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        langs = np.array(shared.value.langs, object)
        for b in cut(batches, BATCH_BYTES // 2, column=text_col):
            texts = b.column(text_col).to_pylist()
            pi, margin = shared.value.judge(texts, penalty)
            keep = np.array([has_letter(t) for t in texts], bool) & (margin > least)
            at = b.schema.get_field_index(lang_col)
            found = pa.array(langs[pi[keep].argmax(1)] if len(langs) else [], b.schema.field(at).type)
            yield b.filter(pa.array(keep)).set_column(at, b.schema.field(at).with_nullable(True), found)

    return df.mapInArrow(run, df.schema)
