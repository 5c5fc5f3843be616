"""Suffix-array deduplication by distributed prefix doubling.

A byte goes if it lies in a string of `length` bytes that also starts at another position. That needs
the suffix order only up to `length`: positions get ranks for prefixes of growing size, from pairs of
the rank at the position and the rank at an offset; Spark sorts the pairs, equal pairs get one new
rank, and positions whose rank is unique leave at once. With sizes 50, 100, 200 the offsets are 50
and 100: the first ranks are names (hashes) of 50 bytes, as if so many bytes made a symbol.

A row for every byte of the corpus wouldn't fit, so positions that can't have an equal one leave
before the doubling. The windows of `length` bytes are cut into runs that share an anchor (see
`anchors`); equal windows have equal anchors at equal places, so a run stands for its windows:

  the gram at the anchor is found once: no window of the run is repeated;
  the bytes under all windows of the run are found twice: all are repeated, without doubling.

What is left, one run of each kind, is cut into blocks of neighbouring windows, by their distance
from the anchor:

  the bytes under all windows of a block are found twice: all are repeated;
  the bytes that all windows of a block share are found once: none is.

The windows of the other blocks are doubled: their starts, and the positions at the offsets from them.
If a position's rank is unique at one size, it is at all larger ones, and so is that of a position
that needs it; so a position without its partner leaves too.

A pair that very many positions have (a passage in a third of all documents) is dealt to several
tasks: pairs are counted in a sketch of fixed size over all rows, and the rows of crowded slots are
salted. Their new rank is a name, so that tasks agree on it, and in the last round each task sends
one row a crowded pair on, to find the pairs that several tasks hold once.

Defined results: a null text counts as empty; texts shorter than `length` keep all bytes; repeated
rows are copies of each other and lose what they repeat; null ids are kept; an empty table gives an
empty one. The bytes kept need not be valid UTF-8, so they are binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sums
from .anchors import Runs
from .rolling import BASE2, BYTE_VALUE, BYTE_VALUE2, Batch, Prefix, U, mix
from .runtime import BATCH_BYTES, cut, drop, shared_dir, written

LENGTH = 200
#: Doublings: the first ranks are names of a 2 ** ROUNDS-th of the length.
ROUNDS = 2
#: Rows of a slot of the sketch that go to one task, about.
CROWD = 100_000
SKETCH = 1 << 20
#: Windows of a block.
BLOCK = 16


def sizes_of(length: int, rounds: int = ROUNDS) -> list[int]:
    """The prefix sizes, the last one the length; each is twice the one before at most."""
    return [-(-length // (1 << k)) for k in range(rounds, -1, -1)]


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a key of the row (rid, th): rows with one key are copies of each other."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("rid", F.xxhash64("doc_id", "text")).withColumn("th", F.hash("text"))


#: Bytes laid out at once: some 15 arrays of 8 bytes each are made for a byte.
BYTES = BATCH_BYTES // 4


def batches_of_runs(batches, length: int, gram: int):
    for b in cut(batches, BYTES):
        batch = Batch(b.column("text").to_pylist())
        yield b, Runs(batch, length, gram)


def grams(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The name of the gram at each anchor."""

    def run(batches):
        for _, r in batches_of_runs(batches, length, gram):
            yield pa.RecordBatch.from_arrays([pa.array(r.gram_hash().view(np.int64))], names=["cls"])

    return texts.select("text").mapInArrow(run, "cls long")


def runs(texts: DataFrame, length: int, gram: int, seen) -> DataFrame:
    """Each run whose gram may be repeated (its bit is set in the map): name of its gram, of all its bytes (ua, ub), its row, and its place.

    pos packs the first window's start, one less than the number of windows, and the anchor's distance.
    """

    def run(batches):
        for b, r in batches_of_runs(batches, length, gram):
            cls = r.gram_hash()
            maybe = np.flatnonzero(sums.marked(seen.value, cls))
            r.pick(maybe)
            ua, ub = r.context()
            pos = ((r.low - r.begin) << 16) | ((r.high - r.low) << 8) | (r.at - r.low)
            rid, th = (b.column(c).to_numpy()[r.text] for c in ("rid", "th"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cls[maybe].view(np.int64), ua.view(np.int64), (ub >> U(32)).astype(np.uint32).view(np.int32), rid, th, pos)], names=["cls", "ua", "ub", "rid", "th", "pos"])

    return texts.select("text", "rid", "th").mapInArrow(run, "cls long, ua long, ub int, rid long, th int, pos long")


def of_rows(texts: DataFrame, keys, present: bool = True) -> DataFrame:
    """The texts whose rid may be in the map, or those whose rid isn't."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(sums.marked(keys.value, b.column("rid").to_numpy()) == present))

    return texts.mapInArrow(run, texts.schema)


def listed(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of a column of lists of structs: the row of each entry, and the entries' fields."""
    n = pc.list_value_length(column).fill_null(0).to_numpy()
    flat = column.flatten()
    return np.repeat(np.arange(len(n)), n), {f.name: flat.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(flat.type)}


def blocks(asked: DataFrame, length: int) -> DataFrame:
    """The blocks of the open runs: cls, block, name of the bytes that its windows share (core), of all their bytes (ua, ub), and place. asked: did, text, spans (cls, low, n, far, known)."""

    def run(batches):
        for b in cut(batches, BYTES):
            batch = Batch(b.column("text").to_pylist())
            row, s = listed(b.column("spans"))
            most, least = s["far"].astype(np.int64), (s["far"] - s["n"] + 1).astype(np.int64)
            n = most // BLOCK - least // BLOCK + 1
            of = np.repeat(np.arange(len(n)), n)
            block = (least // BLOCK)[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            anchor = (batch.offsets[row] + s["low"] + most)[of]
            far, near = np.minimum(most[of], block * BLOCK + BLOCK - 1), np.maximum(least[of], block * BLOCK)
            one, two = Prefix(BYTE_VALUE[batch.data]), Prefix(BYTE_VALUE2[batch.data], BASE2)
            core = one.ranges(anchor - block * BLOCK, anchor - block * BLOCK - BLOCK + 1 + length)
            ua, ub = (x.ranges(anchor - far, anchor - near + length) for x in (one, two))
            low = anchor - far - batch.offsets[row][of]
            columns = (s["cls"][of], block.astype(np.int32), core.view(np.int64), ua.view(np.int64), (ub >> U(32)).astype(np.uint32).view(np.int32), b.column("did").to_numpy()[row][of], low.astype(np.int32), (far - near + 1).astype(np.int32), s["known"][of])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["cls", "block", "core", "ua", "ub", "did", "low", "n", "known"])

    return asked.select("did", "text", "spans").mapInArrow(run, "cls long, block int, core long, ua long, ub int, did long, low int, n int, known boolean")


PAIRS = "k1 long, k2 long, did long, start int, own byte, part int, counts binary"
#: own: 1 for a window that is asked for, 2 for one that is known to be repeated, 0 for a position that only windows before it need.


def pair_rows(k1, k2, did, start, own) -> pa.RecordBatch:
    n = len(k1)
    return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(did), pa.array(start.astype(np.int32)), pa.array(own.astype(np.int8)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["k1", "k2", "did", "start", "own", "part", "counts"])


def sketch_rows(sketch: np.ndarray):
    """The counts of a task's pairs by slot, as rows of their own."""
    if (parts := sums.packed(sketch)) is not None:
        n = parts.num_rows
        yield pa.RecordBatch.from_arrays([pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int8())] + parts.columns, names=["k1", "k2", "did", "start", "own", "part", "counts"])


def slot_of(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    return (mix(k1.view(U) * U(0x9E3779B97F4A7C15) + k2.view(U)) >> U(44)).astype(np.int64)


def first_pairs(asked: DataFrame, sizes: list[int]) -> DataFrame:
    """(name at a position, name at the first offset) of the positions that the doubling needs. asked: did, text, spans (low, n, known)."""

    def run(batches):
        sketch = np.zeros(SKETCH, np.uint32)
        for b in cut(batches, BYTES):
            batch = Batch(b.column("text").to_pylist())
            of, s = listed(b.column("spans"))
            low, n, known = batch.offsets[of] + s["low"], s["n"].astype(np.int64), s["known"]
            window = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = np.zeros(len(batch.data), np.int8)
            own[window] = np.where(np.repeat(known, n), 2, 1)
            need = own > 0
            for k in range(len(sizes) - 1, 1, -1):
                offset = sizes[k] - sizes[k - 1]
                need[offset:] |= need[:-offset].copy()
            at = np.flatnonzero(need)
            names, first = Prefix(BYTE_VALUE[batch.data]), sizes[0]
            k1, k2 = names.ranges(at, at + first), names.ranges(at + sizes[1] - first, at + sizes[1])
            np.add.at(sketch, slot_of(k1, k2), 1)
            row = np.searchsorted(batch.offsets, at, "right") - 1
            yield pair_rows(k1.view(np.int64), k2.view(np.int64), b.column("did").to_numpy()[row], at - batch.offsets[row], own[at])
        yield from sketch_rows(sketch)

    return asked.select("did", "text", "spans").mapInArrow(run, PAIRS)


def next_pairs(ranked: DataFrame, offset: int, last: bool) -> DataFrame:
    """(rank at a position, rank at the offset from it) where both have one; in the last round only of windows. ranked: did, start, rank, own."""

    def resolve(did, start, rank, own, upto):
        """The pairs of the rows before upto; all later partners are there."""
        group = np.concatenate(([0], np.cumsum(did[1:] != did[:-1])))
        key = (group << 32) | start
        at = np.minimum(np.searchsorted(key, key[:upto] + offset), len(key) - 1)
        keep = np.flatnonzero((key[at] == key[:upto] + offset) & ((own[:upto] > 0) | (not last)))
        return rank[keep], rank[at[keep]], did[keep], start[keep], own[keep]

    def run(batches):
        sketch, held = np.zeros(SKETCH, np.uint32), None
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(c).to_numpy() for c in ("did", "start", "rank", "own")]
            rows[1] = rows[1].astype(np.int64)
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            did, start = rows[:2]
            open_ = (did == did[-1]) & (start + offset > start[-1])
            upto = int(np.argmax(open_))  # rows are sorted, so the open ones are the last
            out = resolve(*rows, upto)
            held = [x[upto:] for x in rows]
            np.add.at(sketch, slot_of(out[0], out[1]), 1)
            yield pair_rows(*out)
        if held is not None:
            out = resolve(*held, len(held[0]))
            np.add.at(sketch, slot_of(out[0], out[1]), 1)
            yield pair_rows(*out)
        yield from sketch_rows(sketch)

    return ranked.repartition("did").sortWithinPartitions("did", "start").mapInArrow(run, PAIRS)


def sorted_pairs(table: DataFrame) -> DataFrame:
    """The pairs of a written table, dealt by pair and sorted; those of crowded slots are salted. k1, k2, did, start, own, crowded."""
    spark = table.sparkSession
    counts = sums.summed(table.where("part IS NOT NULL").select("part", "counts"), SKETCH)
    crowds = spark.sparkContext.broadcast({int(k): -(-int(counts[k]) // CROWD) for k in np.flatnonzero(counts > CROWD)})  # slots at most
    rows = table.where("part IS NULL").drop("part", "counts")
    if not crowds.value:
        rows = rows.withColumn("salt", F.lit(0)).withColumn("crowded", F.lit(False))
    else:

        def salt(batches):
            parts = np.ones(SKETCH, np.int64)
            for k, n in crowds.value.items():
                parts[k] = n
            for b in batches:
                n = parts[slot_of(b.column("k1").to_numpy(), b.column("k2").to_numpy())]
                by = (mix(b.column("did").to_numpy().view(U)) % n.astype(U)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(by), pa.array(n > 1)], names=[*b.schema.names, "salt", "crowded"])

        rows = rows.mapInArrow(salt, "k1 long, k2 long, did long, start int, own byte, salt int, crowded boolean")
    return rows.repartition("k1", "k2", "salt").sortWithinPartitions("k1", "k2").drop("salt")


def in_groups(batches):
    """Of sorted pairs: batch by batch, rows with whether an equal pair is next to each, and the number of its group. The last row waits for the next batch."""
    held, twice, number = None, False, 0
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([held, b] if held is not None else [b]).combine_chunks().to_batches()[0]
        k1, k2 = t.column("k1").to_numpy(), t.column("k2").to_numpy()
        same = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
        hit = np.append(same, False)
        hit[1:] |= same
        hit[0] |= twice and held is not None
        group = number + np.concatenate(([0], np.cumsum(~same)))
        last = len(hit) - 1
        yield t.slice(0, last), hit[:last], group[:last]
        held, twice, number = t.slice(last), bool(hit[-1]), int(group[-1])
    if held is not None:
        yield held, np.array([twice]), np.array([number])


def reranked(pairs: DataFrame) -> DataFrame:
    """did, start, rank, own of the positions whose pair isn't unique: equal pairs get equal ranks. A crowded pair's rank is a name below 0, and it stays even if it is unique."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 40
        for t, hit, group in in_groups(batches):
            crowded = t.column("crowded").to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(hit | crowded)
            if not len(keep):
                continue
            rank = task + group[keep]
            if (c := crowded[keep]).any():
                k1, k2 = (t.column(k).to_numpy()[keep].view(U) for k in ("k1", "k2"))
                rank = np.where(c, (mix(mix(k1 + U(1)) ^ k2 * U(0xD1342543DE82EF95)) | U(1 << 63)).view(np.int64), rank)
            some = t.select(["did", "start", "own"]).take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([some.column("did"), some.column("start"), pa.array(rank), some.column("own")], names=["did", "start", "rank", "own"])

    return sorted_pairs(pairs).mapInArrow(run, "did long, start int, rank long, own byte")


def repeated(pairs: DataFrame, folder: str) -> DataFrame:
    """(did, start) of the windows whose last pair isn't unique, without those known before."""

    def run(batches):
        for t, hit, group in in_groups(batches):
            own, crowded = t.column("own").to_numpy(), t.column("crowded").to_numpy(zero_copy_only=False)
            # of a crowded pair each task sends a single row on, or one of several for its group's sake
            first = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, bool)
            kind = np.where(hit & (own == 1), 1, 0) | np.where(crowded & (~hit | first), 2, 0)
            keep = np.flatnonzero(kind)
            if len(keep):
                some = t.select(["k1", "k2", "did", "start", "own"]).take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(kind[keep].astype(np.int8)), pa.array(hit[keep])], names=["k1", "k2", "did", "start", "own", "kind", "hit"])

    found = written(sorted_pairs(pairs).mapInArrow(run, "k1 long, k2 long, did long, start int, own byte, kind byte, hit boolean"), folder)
    crowded = found.where("kind >= 2")
    twice = crowded.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")
    late = crowded.where("NOT hit AND own = 1").join(twice, ["k1", "k2"]).select("did", "start")
    return found.where("kind IN (1, 3)").select("did", "start").unionByName(late)


REMOVED = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
STRIPPED = "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary"


def untouched(texts: DataFrame, keys) -> DataFrame:
    """The rows of `strip` for the texts that lose nothing: those whose rid isn't in the map."""

    def run(batches):
        for b in of_map(batches):
            raw = b.column("text").cast(pa.binary())
            n = pc.binary_length(raw).cast(pa.int64())
            none = pa.ListArray.from_arrays(pa.array(np.zeros(len(raw) + 1, np.int32)), pa.array([], REMOVED.value_type))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, none, raw], names=["doc_id", "n_bytes", "removed", "kept"])

    def of_map(batches):
        for b in batches:
            if (some := b.filter(pa.array(~sums.marked(keys.value, b.column("rid").to_numpy())))).num_rows:
                yield from cut([some])

    return texts.mapInArrow(run, STRIPPED)


def strip(rows: DataFrame, length: int) -> DataFrame:
    """doc_id, n_bytes, spans removed (start, end) and the bytes kept. rows: doc_id, text, spans of repeated windows: n from low on, or those with a bit in bits (from low on)."""

    def run(batches):
        for b in cut(batches):
            out = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                raw = text.encode("utf-8")
                if not spans:
                    out.append((len(raw), [], raw))
                    continue
                edge = np.zeros(len(raw) + 1, np.int32)
                low, n, bits = (np.array([s[c] for s in spans]) for c in ("low", "n", "bits"))
                some = np.flatnonzero(bits)
                block, single = np.nonzero(np.unpackbits(bits[some].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                low, n = np.append(low[bits == 0], low[some][block] + single), np.append(n[bits == 0], np.ones(len(single), np.int64))
                np.add.at(edge, low, 1)
                np.add.at(edge, low + n + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                cuts = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).view(np.int8)))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((len(raw), [{"start": s, "end": e} for s, e in zip(cuts[0::2].tolist(), cuts[1::2].tolist())], kept))
            n_bytes, removed, kept = zip(*out)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, REMOVED), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return rows.mapInArrow(run, STRIPPED)


def deduplicate(df: DataFrame, length: int = LENGTH, gram: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, removed spans and kept bytes of every document."""
    gram = gram or length // 2
    sizes = sizes_of(length)
    if not gram < length <= gram + 255 or length < 2 * BLOCK or gram < 1:
        raise ValueError(f"length must be {2 * BLOCK} or more, and above gram by 1 to 255")
    spark = df.sparkSession
    folder = shared_dir(spark, "suffixes")
    at = lambda name: f"{folder}/{name}"
    texts = keyed(df, id_col, text_col)
    context = ["cls", "ua", "ub"]

    twice = written(grams(texts, length, gram).groupBy("cls").agg(F.count("*").alias("c")).where("c > 1").select("cls"), at("grams"))
    seen = spark.sparkContext.broadcast(sums.bitmap(twice, "cls"))
    left = written(runs(texts, length, gram, seen).join(twice, "cls", "left_semi"), at("runs"))

    first = lambda c: F.min_by(c, "rid").alias(c)
    unions = written(left.groupBy(*context).agg(F.count("*").alias("c"), F.min("rid").alias("rid"), first("th"), first("pos")), at("contexts"))
    low, n = F.shiftright("pos", 16).cast("int").alias("low"), (F.shiftright("pos", 8).bitwiseAND(255) + 1).cast("int").alias("n")
    whole = written(left.join(unions.where("c > 1").select(*context), context, "left_semi").select("rid", "th", low, n), at("whole"))
    drop(spark, at("grams"), at("runs"))

    kinds = written(unions.groupBy("cls").agg(F.count("*").alias("d"), F.min("c").alias("least")).where("d > 1 AND least = 1").select("cls"), at("kinds"))
    far = F.col("pos").bitwiseAND(255).cast("int").alias("far")  # of the anchor from the first window's start
    spans = unions.join(kinds, "cls", "left_semi").groupBy("rid", "th").agg(F.collect_list(F.struct("cls", low, n, far, (F.col("c") > 1).alias("known"))).alias("spans"))  # no more than a text has positions
    spans = written(spans.withColumn("did", F.monotonically_increasing_id()), at("spans"))
    drop(spark, at("contexts"), at("kinds"))

    slim, names = texts.select("text", "rid", "th"), spans.select("did", "rid", "th")
    with_text = lambda t: of_rows(slim, spark.sparkContext.broadcast(sums.bitmap(t, "rid"))).join(t, ["rid", "th"])
    subs = written(blocks(with_text(spans), length), at("blocks"))
    group, first = ["cls", "block", "core", "ua", "ub"], lambda c: F.min_by(c, "did").alias(c)
    kinds = written(subs.groupBy(*group).agg(F.count("*").alias("c"), F.min("did").alias("did"), first("low"), first("n"), F.max("known").alias("known")), at("block-kinds"))
    twice = kinds.where("c > 1").select(*group)
    bulk = written(subs.where("NOT known").join(twice, group, "left_semi").select("did", "low", "n"), at("bulk"))
    left = kinds.select("cls", "block", "core", "did", "low", "n", (F.col("known") | (F.col("c") > 1)).alias("known"))
    cores = written(left.groupBy("cls", "block", "core").agg(F.count("*").alias("d"), F.min("known").alias("all")).where("d > 1 AND NOT all").select("cls", "block", "core"), at("cores"))
    closer = left.join(cores, ["cls", "block", "core"], "left_semi").groupBy("did").agg(F.collect_list(F.struct("low", "n", "known")).alias("spans"))
    closer = written(closer.join(names, "did"), at("closer"))
    drop(spark, at("blocks"), at("block-kinds"), at("cores"))

    asked = with_text(closer)
    pairs, last = written(first_pairs(asked, sizes), at("pairs-1")), None
    for k in range(2, len(sizes)):
        ranked = written(reranked(pairs), at(f"ranks-{k}"))
        drop(spark, at(f"pairs-{k - 1}"))
        pairs = written(next_pairs(ranked, sizes[k] - sizes[k - 1], k == len(sizes) - 1), at(f"pairs-{k}"))
        drop(spark, at(f"ranks-{k}"))
        last = at(f"pairs-{k}")
    found = repeated(pairs, at("repeated")).withColumn("low", F.shiftright("start", 6) * 64).withColumn("bit", F.expr("shiftleft(1L, start & 63)"))
    found = found.groupBy("did", "low").agg(F.bit_or("bit").alias("bits")).select("did", "low", F.lit(0).alias("n"), "bits")
    none = F.lit(0).cast("long").alias("bits")
    late = bulk.select("*", none).unionByName(found).join(names, "did").select("rid", "th", "low", "n", "bits")
    every = whole.select("*", none).unionByName(late)
    gone = written(every.groupBy("rid", "th").agg(F.collect_list(F.struct("low", "n", "bits")).alias("spans")), at("gone"))
    drop(spark, last, *map(at, ("repeated", "closer", "bulk", "spans", "whole")))

    keys = spark.sparkContext.broadcast(sums.bitmap(gone, "rid"))
    changed = strip(of_rows(texts, keys).join(gone, ["rid", "th"], "left").select("doc_id", "text", "spans"), length)
    return untouched(texts, keys).unionByName(changed)


def digest(stripped: DataFrame) -> DataFrame:
    """The columns of the query."""
    return stripped.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
