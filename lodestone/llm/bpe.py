"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The most frequent words of the corpus (counted over all documents) are encoded once by the exact
merge path and compiled into a minimal acyclic automaton: equal suffixes share their states, every
edge carries the number of words that sort before those behind it, so the sum along a word's path
is its number, and the number gives its ids. States and edges lie in flat arrays (displaced rows, a
check array) in one file that workers memory-map. A batch's words walk the automaton together,
one byte a step, in numpy. A word that falls off goes through the exact path, piece by piece.

Defined results: a null text counts as empty and has no ids; null ids of documents are kept;
repeated rows each get a row; added tokens in a text become their ids, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .rolling import Batch
from .runtime import cut, documents, kept, shared_dir, written
from .vocab import Vocabulary

#: Most words in the lexicon, and most bytes of a word in it: the automaton stays a few MB whatever the corpus.
MOST_WORDS = 1 << 16
LONGEST = 48
#: Most pieces and words a worker remembers besides, at some 250 bytes each: workers live on after their stage.
REMEMBERED = 150_000


class Builder:
    """Minimal acyclic automaton from words in ascending order of bytes."""

    def __init__(self):
        self.edges: list[dict[int, int]] = [{}]
        self.final = [False]
        self.known: dict[tuple, int] = {}
        self.path: list[tuple[int, int, int]] = []  # (parent, byte, state) that may still change
        self.last = b""

    def add(self, word: bytes) -> None:
        if word <= self.last and self.last:
            raise ValueError("words must ascend")
        common = len(os.path.commonprefix([word, self.last]))
        self.settle(common)
        state = self.path[-1][2] if self.path else 0
        for byte in word[common:]:
            self.edges.append({})
            self.final.append(False)
            self.edges[state][byte] = len(self.edges) - 1
            self.path.append((state, byte, len(self.edges) - 1))
            state = len(self.edges) - 1
        self.final[state] = True
        self.last = word

    def settle(self, depth: int) -> None:
        """States deeper than that won't change: merge each with an equal one."""
        while len(self.path) > depth:
            parent, byte, state = self.path.pop()
            key = (self.final[state], tuple(self.edges[state].items()))
            have = self.known.setdefault(key, state)
            if have != state:
                self.edges[parent][byte] = have

    def arrays(self) -> dict[str, np.ndarray]:
        """base, check, target, skip, final: edge by byte b of state s is at base[s] + b if check there is s."""
        self.settle(0)
        order, seen, stack = [], set(), [(0, False)]
        while stack:  # children before parents
            s, done = stack.pop()
            if done:
                order.append(s)
            elif s not in seen:
                seen.add(s)
                stack.append((s, True))
                stack += [(t, False) for t in self.edges[s].values() if t not in seen]
        number = {s: k for k, s in enumerate(sorted(seen))}
        below: dict[int, int] = {}
        for s in order:
            below[s] = self.final[s] + sum(below[t] for t in self.edges[s].values())
        n_edges = sum(len(self.edges[s]) for s in seen)
        size = 4 * n_edges + 1024
        check, target, skip = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
        base, final = np.zeros(len(seen), np.int32), np.zeros(len(seen), bool)
        used, at_least = bytearray(size), {}  # by number of edges, where the search for room goes on
        for s in sorted(seen, key=lambda s: -len(self.edges[s])):
            k, codes = number[s], sorted(self.edges[s])
            final[k] = self.final[s]
            if not codes:
                continue
            shift = [c - codes[0] for c in codes[1:]]
            slot = at_least.get(len(codes), 256)
            while used[slot] or any(used[slot + c] for c in shift):
                slot += 1
            at_least[len(codes)] = slot + 1
            base[k], before = slot - codes[0], int(self.final[s])
            for c in codes:
                at, t = int(base[k]) + c, self.edges[s][c]
                used[at], check[at], target[at], skip[at] = 1, k, number[t], before
                before += below[t]
        return {"base": base, "check": check, "target": target, "skip": skip, "final": final.view(np.uint8)}


class Lexicon:
    """The compiled file, memory-mapped."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = json.loads(f.readline())
            at = f.tell()
        whole = np.memmap(path, np.uint8, "r")
        for name, kind, n in head["arrays"]:
            size = n * np.dtype(kind).itemsize
            setattr(self, name, whole[at : at + size].view(kind))
            at += size
        self.words, self.longest = len(self.bounds) - 1, head["longest"]

    @staticmethod
    def compile(words: dict[bytes, list[int]], uri: str) -> str:
        """Writes the automaton of the words and their ids; gives the URI back."""
        builder, order = Builder(), sorted(words)
        for w in order:
            builder.add(w)
        bounds = np.zeros(len(order) + 1, np.int64)
        np.cumsum([len(words[w]) for w in order], out=bounds[1:])
        arrays = {"bounds": bounds, "ids": np.array([k for w in order for k in words[w]], np.int64), **builder.arrays()}
        head = json.dumps({"longest": max(map(len, order), default=0), "arrays": [[k, v.dtype.str, len(v)] for k, v in arrays.items()]}).encode()
        head += b" " * (-(len(head) + 1) % 8) + b"\n"
        out = files.Writer(uri)
        out.write(head)
        for values in arrays.values():
            out.write(values.tobytes())
        out.close()
        return uri

    def look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word data[start:end], or -1."""
        out = np.full(len(start), -1, np.int64)
        alive = np.flatnonzero(end - start <= self.longest)
        state, number = np.zeros(len(alive), np.int32), np.zeros(len(alive), np.int32)
        at, stop = start[alive], end[alive]
        while len(alive):
            slot = self.base[state] + data[at]
            ok = self.check[slot] == state
            if not ok.all():
                alive, slot, number, at, stop = alive[ok], slot[ok], number[ok], at[ok], stop[ok]
            state, number, at = self.target[slot], number + self.skip[slot], at + 1
            if (over := at == stop).any():
                accept = over & (self.final[state] == 1)
                out[alive[accept]] = number[accept]
                go = ~over
                alive, state, number, at, stop = alive[go], state[go], number[go], at[go], stop[go]
        return out


class Encoder:
    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.pieces: dict[str, list[int]] = {}
        self.words: dict[bytes, list[int]] = {}

    def exact(self, word: bytes) -> list[int]:
        """The ids of a word outside the lexicon."""
        ids = self.words.get(word)
        if ids is None:
            ids = []
            for added, p in self.vocabulary.parts(word.decode("utf-8", "surrogatepass")):
                if added:
                    ids.append(self.vocabulary.added[p])
                    continue
                got = self.pieces.get(p)
                if got is None:
                    got = self.vocabulary.merge(p)
                    if len(self.pieces) < REMEMBERED:
                        self.pieces[p] = got
                ids += got
            if len(self.words) < REMEMBERED:
                self.words[word] = ids
        return ids

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and the bounds of each text's."""
        b = Batch(texts)
        start, end, first = b.words()
        number = self.lexicon.look_up(b.data, start, end) if self.lexicon else np.full(len(start), -1, np.int64)
        missed = np.flatnonzero(number < 0)
        raw = b.data.tobytes()
        rest = [self.exact(raw[s:e]) for s, e in zip(start[missed].tolist(), end[missed].tolist())]
        size = np.zeros(len(start), np.int64)
        hit = np.flatnonzero(number >= 0)
        if len(hit):
            low, high = self.lexicon.bounds[number[hit]], self.lexicon.bounds[number[hit] + 1]
            size[hit] = high - low
        size[missed] = [len(x) for x in rest]
        place = np.zeros(len(start) + 1, np.int64)
        np.cumsum(size, out=place[1:])
        ids = np.zeros(place[-1], np.int32)
        if len(hit):
            n = size[hit]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ids[np.repeat(place[hit], n) + step] = self.lexicon.ids[np.repeat(low, n) + step]
        if len(missed):
            n = size[missed]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ids[np.repeat(place[missed], n) + step] = np.fromiter((k for x in rest for k in x), np.int32, int(n.sum()))
        return ids, place[first]


def encoder(vocabulary_path: str, lexicon_uri: str | None) -> Encoder:
    """One per worker process."""
    return kept(("encoder", vocabulary_path, lexicon_uri), lambda: Encoder(Vocabulary(vocabulary_path), Lexicon(files.local_copy(lexicon_uri)) if lexicon_uri else None))


def frequent_words(df: DataFrame, text_col: str = "text", most: int = MOST_WORDS) -> list[str]:
    """The most frequent words over all texts: as many counts from the top as give at most so many words."""
    words = df.select(F.explode(F.split(F.col(text_col).cast("string"), r"[\x20\x09-\x0D]+")).alias("w")).where(F.col("w") != "")
    counted = words.where(F.octet_length("w") <= LONGEST).groupBy("w").agg(F.count("*").alias("n")).where("n > 1")
    counted = written(counted, shared_dir(df.sparkSession, "words"))
    least, so_far = 1 << 62, 0
    for r in counted.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most + 1).collect():  # a row per count that occurs; each has a word, so more than `most` of them are never needed
        so_far += r.words
        if so_far > most:
            break
        least = r.n
    return [r.w for r in counted.where(F.col("n") >= least).select("w").collect()]


def compile_lexicon(df: DataFrame, vocabulary_path: str, text_col: str = "text", most: int = MOST_WORDS) -> str:
    """Counts words, compiles the transducer into the shared folder and gives its URI."""
    spark: SparkSession = df.sparkSession
    exact = Encoder(Vocabulary(vocabulary_path), None).exact
    words = {w.encode("utf-8"): exact(w.encode("utf-8")) for w in frequent_words(df, text_col, most)}
    return Lexicon.compile(words, shared_dir(spark, "lexicon") + "/lexicon.bin")


def encode(df: DataFrame, vocabulary_path: str, lexicon_uri: str, id_col: str = "doc_id", text_col: str = "text", then=None, schema: str = "doc_id long, ids array<int>") -> DataFrame:
    """doc_id and the ids of every text; or what `then` makes of the batches of these rows, in the same worker, with its schema."""

    def run(batches):
        e = encoder(vocabulary_path, lexicon_uri)
        for b in cut(batches):
            ids, bounds = e.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return documents(df, id_col, text_col).mapInArrow(run if then is None else lambda batches: then(run(batches)), schema)


def decode_ids(tokens: dict[int, str], ids) -> str:
    """The tokens joined by spaces: the file names no decoder. Ids without a token are left out."""
    return " ".join([tokens[k] for k in ids if k in tokens])


def decode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded text of every row of ids; null ids count as none."""

    def run(batches):
        tokens = encoder(vocabulary_path, None).vocabulary.tokens
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([decode_ids(tokens, x or ()) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


#: Tokens and decimal numbers by id, one pair per worker process and vocabulary.
_tables: dict = {}
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(vocabulary_path: str):
    """n_tokens, ids_sha256 and decoded_sha256 of batches of ids."""

    def run(batches):
        if vocabulary_path not in _tables:
            vocabulary = Vocabulary(vocabulary_path)
            _tables[vocabulary_path] = [vocabulary.tokens.get(k, "").encode() for k in range(vocabulary.size)], [str(k).encode() for k in range(vocabulary.size)]
        token, decimal = _tables[vocabulary_path]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            out = []
            for ids in b.column("ids"):
                ids = ids.values.to_numpy().tolist() if ids.is_valid else []
                out.append((len(ids), sha(b" ".join([decimal[k] for k in ids])), sha(b" ".join([token[k] for k in ids]))))
            columns = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string())))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def token_digest(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """The digests of rows of ids."""
    return encoded.select("doc_id", "ids").mapInArrow(digests(vocabulary_path), DIGEST)
