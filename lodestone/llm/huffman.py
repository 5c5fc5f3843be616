"""Token ids in binary files under a canonical, length-limited Huffman code.

Code lengths come from the global counts of ids by package-merge, so no code is longer than the
limit; codes are canonical, so a file carries lengths only. A file holds the documents of one range
of doc_id, in ascending order. Its ids are cut into blocks of a fixed number of ids that decode
independently; a block keeps the bits between its checkpoints (one each CHECKPOINT ids), and a
reader starts at all checkpoints at once: each step looks up one id a checkpoint in a table of all
bit patterns of the limit's length.

Layout (little endian): magic, code lengths by id; blocks, each ids n, bits between checkpoints
(uint16), 32-bit big-endian words; the documents (doc_id, ids, validity of doc_id); the footer with
the places of all these. Files and their parts are written whole or not at all.

Defined results: a null text counts as empty (only the end id is written); null doc_ids sort first
and stay null; rows with equal doc_ids follow each other in the order of their staged rows; an empty
table writes no file.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import files, sums
from .deal import dealt
from .runtime import BATCH_BYTES, cut, documents, drop, kept, shared_dir, written

#: Bits of a code at most, for vocabularies of up to 2 ** 16 ids; larger ones get two bits more than a plain number has, up to 24.
LIMIT = 18
BLOCK = 1 << 16
CHECKPOINT = 64
MAGIC = b"LSHUF001"
#: ASCII characters that are neither letters, digits nor white space: a run of them is one piece.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Pieces that the library encodes in one call.
TOGETHER = 1024
#: Ids a file holds, about.
FILE_IDS = 1 << 24


def limit_for(size: int) -> int:
    limit = max(LIMIT, (size - 1).bit_length() + 2)
    if limit > 24:
        raise ValueError(f"{size} ids; at most {1 << 22} are supported")
    return limit


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most that many bits for the ids with counts (package-merge); 0 for the others."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    packages, levels = np.zeros(0), []
    for _ in range(limit):
        both = np.concatenate((leaves, packages))
        order = np.argsort(both, kind="stable")
        levels.append(order < len(leaves))
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    need, own = 2 * len(used) - 2, np.zeros(len(used), np.uint8)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:need].sum())
        own[:n] += 1
        need = 2 * (need - n)
    lengths[used] = own
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        n = lengths[order].astype(np.int64)
        top = np.concatenate(([0], np.cumsum(2.0 ** -n[:-1])))  # exact: sums of powers of 2
        codes[order] = (top * 2.0**n).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and code length for each bit pattern of `width` bits."""
    width = max(int(lengths.max(initial=1)), 1)
    ids, sizes = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    fill = np.int64(1) << (width - lengths[order].astype(np.int64))
    ids[: fill.sum()] = np.repeat(order, fill)
    sizes[: fill.sum()] = np.repeat(lengths[order], fill)
    return ids, sizes, width


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    at = end - n
    words = int(end[-1] + 31) // 32 + 1
    shifted = codes[ids] << (64 - (at & 31) - n).astype(np.uint64)
    both = np.bincount(at >> 5, (shifted >> np.uint64(32)).astype(np.float64), words) + np.bincount((at >> 5) + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), words + 1)[:words]
    marks = np.diff(np.append(at[::CHECKPOINT], end[-1]))
    return struct.pack("<II", len(ids), words) + marks.astype("<u2").tobytes() + both.astype(np.uint32).astype(">u4").tobytes()


def decode_block(data: bytes, table) -> np.ndarray:
    ids, sizes, width = table
    n, words = struct.unpack_from("<II", data)
    lanes = -(-n // CHECKPOINT)
    marks = np.frombuffer(data, "<u2", lanes, 8).astype(np.int64)
    d = np.frombuffer(data, np.uint8, 4 * words, 8 + 2 * lanes).astype(np.uint32)
    d = np.concatenate((d, np.zeros(4, np.uint32)))
    window = (d[:-3] << np.uint32(24)) | (d[1:-2] << np.uint32(16)) | (d[2:-1] << np.uint32(8)) | d[3:]
    at = np.cumsum(marks) - marks
    out = np.zeros((CHECKPOINT, lanes), np.uint32)
    last = n - (lanes - 1) * CHECKPOINT
    for k in range(min(CHECKPOINT, n)):
        if k == last and lanes > 1:
            at = at[:-1]
        peek = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - width)
        out[k, : len(at)] = ids[peek]
        at += sizes[peek]
    return out.T.reshape(-1)[:n]


class FileWriter:
    def __init__(self, uri: str, lengths: np.ndarray):
        self.out, self.uri, self.lengths, self.codes = files.Writer(uri), uri, lengths, canonical(lengths)
        self.out.write(MAGIC + struct.pack("<I", len(lengths)) + lengths.tobytes())
        self.docs, self.blocks, self.waiting, self.n_waiting, self.n_ids = [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, len(ids), doc_id is not None))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= BLOCK:
            self.flush()

    def flush(self, whole: bool = False) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        stop = len(ids) if whole else len(ids) // BLOCK * BLOCK
        for lo in range(0, stop, BLOCK):
            self.blocks.append(self.out.size)
            self.out.write(encode_block(ids[lo : min(lo + BLOCK, stop)], self.lengths, self.codes))
        self.waiting = [ids[stop:]]
        self.n_waiting = len(ids) - stop

    def close(self) -> tuple:
        self.flush(whole=True)
        at, docs = self.out.size, self.docs
        self.out.write(b"".join(np.array([d[k] for d in docs], t).tobytes() for k, t in enumerate(("<i8", "<i8", "u1"))))
        foot = json.dumps({"docs": len(docs), "docs_at": at, "blocks": [*self.blocks, at]}).encode()
        self.out.write(foot + struct.pack("<I", len(foot)) + MAGIC)
        self.out.close()
        return self.uri, len(docs), self.n_ids


class FileReader:
    def __init__(self, uri: str):
        self.file = files.read_at(uri)
        size = self.file.size()
        n, magic = struct.unpack("<I8s", self.file.read_at(12, size - 12))
        head, m = self.file.read_at(12, 0)[:8], struct.unpack("<I", self.file.read_at(4, 8))[0]
        if MAGIC not in (magic,) or head != MAGIC:
            raise ValueError(f"{uri} isn't a file of this format")
        foot = json.loads(self.file.read_at(n, size - 12 - n))
        self.blocks, k = foot["blocks"], foot["docs"]
        self.table = decode_table(np.frombuffer(self.file.read_at(m, 12), np.uint8))
        raw = self.file.read_at(17 * k, foot["docs_at"])
        self.doc_ids, self.sizes, self.valid = np.frombuffer(raw, "<i8", k), np.frombuffer(raw, "<i8", k, 8 * k), np.frombuffer(raw, "u1", k, 16 * k) == 1

    def block(self, k: int) -> np.ndarray:
        return decode_block(self.file.read_at(self.blocks[k + 1] - self.blocks[k], self.blocks[k]), self.table)

    def documents(self):
        """(doc_id, ids) in the file's order, one block in memory besides a document's own ids."""
        k, have = 0, np.zeros(0, np.uint32)
        for doc_id, n, valid in zip(self.doc_ids.tolist(), self.sizes.tolist(), self.valid.tolist()):
            parts, missing = [], n
            while missing > len(have):
                parts.append(have)
                missing -= len(have)
                have, k = self.block(k), k + 1
            yield (doc_id if valid else None), np.concatenate([*parts, have[:missing]])
            have = have[missing:]


class Remembered(dict):
    """Values by key, up to about `most`. What is learned beyond is dropped after its batch, as rare keys come once; but when they are asked for twice as often as at first, the texts have changed, and all is learned anew."""

    def __init__(self, most: int):
        self.most, self.usual = most, None

    def keep(self, new: dict, share: float) -> None:
        """Takes new values while there is room; share: of all that was asked for, what was new."""
        if len(self) < self.most:
            self.update(new)
        elif self.usual is None:
            self.usual = share
        elif share > 2 * self.usual:
            self.clear()
            self.usual = None


class CachedLibrary:
    """The library's ids of a text, remembered by word and piece: white space separates words, and pieces are encoded on their own."""

    def __init__(self, path: str, most: int = 500_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        from .vocab import Vocabulary

        self.vocabulary = Vocabulary(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # pieces are normalised and cut already
        self.library.normalizer = normalizers.Sequence([])
        self.library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.kind = np.dtype("<u2") if self.vocabulary.size <= 1 << 16 else np.dtype("<u4")
        self.ends_word = np.array([self.vocabulary.tokens.get(k, "").endswith(self.vocabulary.end) for k in range(self.vocabulary.size)])
        self.words, self.pieces = Remembered(most), Remembered(most)

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of new words, as bytes; only pieces not seen before go to the library."""
        texts, one, two, tails, other = self.vocabulary.normalised(words), [], [], [], []
        for k, t in enumerate(texts):
            if t.isalpha():
                one.append(k)
            elif (stem := t.rstrip(MARKS)).isalpha():
                two.append(k)
                tails.append(t[len(stem) :])
                texts[k] = stem
            else:
                other.append(k)
        split = [tuple(self.vocabulary.parts(words[k].decode("utf-8", "surrogatepass"))) for k in other]
        asked = {texts[k] for k in one}
        asked.update([texts[k] for k in two], tails, *[[p for added, p in x if not added] for x in split])
        new = [p for p in asked if p not in self.pieces]
        fresh: dict[str, bytes] = {}
        for lo in range(0, len(new), TOGETHER):
            fresh.update(self.library_ids(new[lo : lo + TOGETHER]))
        have = {p: self.pieces[p] for p in asked if p not in fresh} | fresh
        self.pieces.keep(fresh, len(new) / max(1, len(asked)))
        ids = {t: np.array([k], self.kind).tobytes() for t, k in self.vocabulary.added.items()}
        out = {words[k]: have[texts[k]] for k in one}
        out.update([(words[k], have[texts[k]] + have[tail]) for k, tail in zip(two, tails)])
        out.update([(words[k], b"".join([ids[p] if added else have[p] for added, p in x])) for k, x in zip(other, split)])
        return out

    def library_ids(self, some: list[str]) -> dict[str, bytes]:
        """The library's ids of pieces, encoded as one text; a piece ends where a token ends a word."""
        ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(some):  # a piece that the library cuts in two
            return {p: np.array(e.ids, self.kind).tobytes() for p, e in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False))}
        raw, size = ids.tobytes(), self.kind.itemsize
        at = [0, *(ends * size).tolist()]
        return {p: raw[a:b] for p, a, b in zip(some, at, at[1:])}

    def encode(self, texts) -> list[bytes]:
        split = self.vocabulary.words(texts)
        found = [list(map(self.words.get, x)) for x in split]
        missed = [[k for k, v in enumerate(x) if v is None] if None in x else () for x in found]
        new = list({x[k] for x, at in zip(split, missed) for k in at})
        if new:
            learned = self.learn(new)
            for x, ids, at in zip(split, found, missed):
                for k in at:
                    ids[k] = learned[x[k]]
            self.words.keep(learned, sum(map(len, missed)) / sum(map(len, split)))
        return list(map(b"".join, found))


def stage(df: DataFrame, vocabulary_path: str, end_id: int, id_col: str, text_col: str, path: str) -> DataFrame:
    """Written rows (task, row, doc_id, n, ids): ids of whole texts with the end id, as bytes; task and row number the rows for good.

    Each task adds its counts of ids, as rows (part, counts).
    """

    def run(batches):
        from pyspark import TaskContext

        library, task, row = kept(("library", vocabulary_path), lambda: CachedLibrary(vocabulary_path)), TaskContext.get().partitionId(), 0
        end = np.array([end_id], library.kind).tobytes()
        size = max(library.vocabulary.size, end_id + 1)
        total = np.zeros(size, np.int64)
        for b in cut(batches, 2 * BATCH_BYTES):
            ids = [x + end for x in library.encode(b.column("text").to_pylist())]
            n = len(ids)
            total += np.bincount(np.frombuffer(b"".join(ids), library.kind), minlength=size)
            yield pa.RecordBatch.from_arrays([pa.array([task] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), b.column("doc_id"), pa.array([len(x) // library.kind.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=STAGED)
            row += n
        if (counts := sums.packed(np.minimum(total, 0xFFFFFFFF).astype(np.uint32))) is not None:
            n = counts.num_rows
            yield pa.RecordBatch.from_arrays([pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())] + counts.columns, names=STAGED)

    return written(documents(df, id_col, text_col).mapInArrow(run, "task int, row long, doc_id long, n long, ids binary, part int, counts binary"), path)


STAGED = ["task", "row", "doc_id", "n", "ids", "part", "counts"]


def write(df: DataFrame, vocabulary_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, counts, and writes the files; gives their manifest (path, docs, ids, base), in the order of doc_id."""
    from .vocab import Vocabulary

    spark: SparkSession = df.sparkSession
    size = max(Vocabulary(vocabulary_path).size, end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    folder = shared_dir(spark, "token-ids")
    staged = stage(df, vocabulary_path, end_id, id_col, text_col, f"{folder}/staged")
    lengths = code_lengths(sums.summed(staged.where("part IS NOT NULL").select("part", "counts"), size).astype(np.int64), limit_for(size))
    staged = staged.where("part IS NULL")
    shared = spark.sparkContext.broadcast(lengths)
    n_files = max(2 * spark.sparkContext.defaultParallelism, (staged.agg(F.sum("n")).first()[0] or 0) // FILE_IDS)

    def run(batches):
        from pyspark import TaskContext

        out, file = None, TaskContext.get().partitionId()
        for b in batches:
            for doc_id, x in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                if out is None:
                    out = FileWriter(f"{folder}/ids-{file:06d}.bin", shared.value)
                out.add(doc_id, np.frombuffer(x.as_buffer(), kind).astype(np.uint32))
        if out is not None:
            path, docs, ids = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([path]), pa.array([docs], pa.int64()), pa.array([ids], pa.int64())], names=["file", "path", "docs", "ids"])

    key = ["doc_id", "task", "row"]  # task and row keep equal doc_ids apart, so many of them still spread over files
    ordered = staged.repartitionByRange(n_files, *key).sortWithinPartitions(*key)
    files_ = written(ordered.select("doc_id", "ids").mapInArrow(run, "file long, path string, docs long, ids long"), f"{folder}/files")
    drop(spark, f"{folder}/staged")
    return written(with_bases(files_), f"{folder}/manifest")


def with_bases(files_: DataFrame, together: int = 1024) -> DataFrame:
    """path, docs, ids and base (the ids of all files before) of written rows by file number: sums within runs of files, then over the runs, a row for each of which is ordered in one task."""
    before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = files_.withColumn("run", F.floor(F.col("file") / together))
    runs = rows.groupBy("run").agg(F.sum("ids").alias("ids")).select("run", before(W.orderBy("run")).alias("first"))
    return rows.withColumn("within", before(W.partitionBy("run").orderBy("file"))).join(runs, "run").select("path", "docs", "ids", (F.col("first") + F.col("within")).alias("base"))


def read(manifest: DataFrame, fn, schema: str) -> DataFrame:
    """fn(doc_id, start, ids) -> a row for every document of the files, files that lie together in one task where there are more than MOST_TASKS."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                rows = []
                for doc_id, ids in FileReader(path).documents():
                    rows.append(fn(doc_id, start, ids))
                    start += len(ids)
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return dealt(manifest.select("path", "base"), "path").mapInArrow(run, schema)


def ids_digest(manifest: DataFrame) -> DataFrame:
    return read(manifest, lambda doc_id, start, ids: (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start and ids of every document."""
    return read(manifest, lambda doc_id, start, ids: (doc_id, start, ids.astype(np.int64)), "doc_id long, start long, ids array<long>")
