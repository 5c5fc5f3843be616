"""Transaction log reassembly: what a log of several sources' transactions leaves in one shared store.

Each source writes changes, savepoints, rollbacks, commits and aborts. A rollback undoes its transaction's
changes since the latest savepoint that is still there (without one, all of them) and removes that savepoint; an
abort, or the end of the log, undoes all. A commit applies what is left. Every `per_epoch` commits end an epoch.

1. The log is dealt by ranges of (source, pos), so a source with a third of all rows lies in many tasks. A stack
   machine reads each source's slice in order. It buffers changes in a frame for each savepoint. What was open where the
   slice begins it doesn't know: rollbacks that reach below its own frames and the first end are noted in the slice's
   summary, and frames that are open at the slice's end wait there.
2. A second machine reads a source's summaries, a row a slice, and tells each waiting frame how it ends.
3. Commits get their rank over all sources by a distributed running sum, and so their epoch. The last write of each key
   and epoch in the order of (commit, pos) counts; windows with lag over a key's epochs, cut into slices, give what it
   replaces; the differences of each epoch are summed up to it, again over slices.

Only summaries meet: rows a source and slice, or a key and slice, and there are as many slices as shuffle
partitions. Nothing else goes through one task, to the driver or into a broadcast.

Defined results: a row without a position isn't in the log; a null source is one source; rows of one position are
ordered by source, then by what they write (null first), so repeated rows are records of their own; a change without a
value deletes its key; commits without changes count; an empty log gives empty tables; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .deal import partitions, running, summed
from .runtime import drop, shared_dir, written

#: A change or its mark as read by the machine; `row` says what it is (see Slice), by and by_pos how it ended and where.
MACHINE = "row string, slice long, source string, frame int, pos long, key long, value long, by string, by_pos long, undone_by array<long>"
FATES, FATE_NAMES, FATE_TYPES = "slice long, frame int, by string, by_pos long", ["slice", "frame", "by", "by_pos"], [pa.int64(), pa.int32(), pa.string(), pa.int64()]
NAMES = [f.split(" ")[0] for f in MACHINE.split(", ")]
TYPES = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())]
#: Rows that a machine gives at once.
ROWS = 1 << 14


class Slice:
    """The stack machine of a source's slice. Frame 0 goes on with the top frame of what came before until an end is seen."""

    def __init__(self, slice_id: int, source: str):
        self.id, self.source = slice_id, source
        self.frames: list[list[tuple]] = [[]]
        self.reached: list[int] = []  # rollbacks that reach below frame 0
        self.first: tuple | None = None  # the first end: all before it ends there
        self.out: list[tuple] = []

    def end(self, changes: list[tuple], by: str, pos: int) -> None:
        self.out += [("done", self.id, self.source, None, *c, by, pos, None) for c in changes]

    def read(self, kind: str, pos: int, key, value) -> None:
        if kind == "change":
            self.frames[-1].append((pos, key, value))
        elif kind == "savepoint":
            self.frames.append([])
        elif kind == "rollback":
            if len(self.frames) > 1:
                self.end(self.frames.pop(), kind, pos)
            else:
                self.end(self.frames[0], kind, pos)
                self.frames = [[]]
                if self.first is None:
                    self.reached.append(pos)
        else:
            for frame in self.frames:
                self.end(frame, kind, pos)
            self.frames = [[]]
            self.first = self.first or (kind, pos)

    def close(self) -> None:
        for k, frame in enumerate(self.frames):
            self.out += [("waits", self.id, self.source, k, *c, None, None, None) for c in frame]
        self.out.append(("slice", self.id, self.source, len(self.frames), None, None, None, *(self.first or (None, None)), self.reached))


def taken(rows: list[tuple], names=NAMES, types=TYPES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def machines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All slices of a task, whose rows are in the order of source and position."""
    from pyspark import TaskContext

    first, now, done = TaskContext.get().partitionId() << 32, None, 0
    for batch in batches:
        for source, kind, pos, key, value in zip(*(batch.column(c).to_pylist() for c in ("source", "kind", "pos", "key", "value"))):
            if now is None or now.source != source:
                if now is not None:
                    now.close()
                    yield taken(now.out)
                    done += 1
                now = Slice(first + done, source)
            now.read(kind, pos, key, value)
            if len(now.out) >= ROWS:
                yield taken(now.out)
                now.out = []
    if now is not None:
        now.close()
        yield taken(now.out)


def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How the frames that wait end: a source's slices in their order, by the same rules, with frames as wholes."""
    source, frames, out = None, None, []

    def end(refs, by, pos):
        out.extend((*ref, by, pos) for ref in refs)

    for batch in batches:
        for r in batch.to_pylist():
            if frames is None or r["source"] != source:
                for frame in frames or ():
                    end(frame, "abort", None)  # the log's end
                source, frames = r["source"], [[]]
            for pos in r["undone_by"]:
                end(frames[-1], "rollback", pos)
                frames = frames[:-1] or [[]]
            if r["by"] is not None:
                for frame in frames:
                    end(frame, r["by"], r["by_pos"])
                frames = [[]]
            frames[-1].append((r["slice"], 0))
            frames += [[(r["slice"], k)] for k in range(1, r["frame"])]
            if len(out) >= ROWS:
                yield taken(out, FATE_NAMES, FATE_TYPES)
                out.clear()
    for frame in frames or ():
        end(frame, "abort", None)
    if out:
        yield taken(out, FATE_NAMES, FATE_TYPES)


@dataclass
class Reassembled:
    """Written tables. undone: kind, pos, by_pos, key; writes: key, value, pos, source, commit, epoch; epochs: their number."""

    undone: DataFrame
    writes: DataFrame
    epochs: int
    folder: str


def reassemble(log: DataFrame, per_epoch: int = 4) -> Reassembled:
    """log: pos (long), source, kind (commit, abort, savepoint, rollback or change), key (long), value (long; null deletes the key)."""
    spark = log.sparkSession
    folder = shared_dir(spark, "reassembly")
    named = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # a null source is one, too
    rows = written(log.where("pos IS NOT NULL").select("pos", named.alias("source"), "kind", "key", "value"), f"{folder}/log")
    order = ["source", "pos", "kind", "key", "value"]
    read = written(rows.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order).mapInArrow(machines, MACHINE), f"{folder}/read")

    slices = read.where("row = 'slice'").repartition("source").sortWithinPartitions("source", "slice")
    fates = slices.mapInArrow(carry, FATES)
    ended = read.where("row = 'waits'").drop("by", "by_pos").join(fates.hint("merge"), ["slice", "frame"])
    columns = ["by", "pos", "source", "key", "value", "by_pos"]
    ended = written(read.where("row = 'done'").select(columns).unionByName(ended.select(columns)), f"{folder}/ended")

    commits = rows.where("kind = 'commit'").groupBy("pos", "source").agg(F.count("*").alias("n"))
    ranked = running(commits, ["pos", "source"], ["n"], f"{folder}/commits")
    epoch = F.ceil((F.col("upto_n") - F.col("n") + 1) / per_epoch).cast("long")  # of the first of repeated rows, which ended the transaction
    ranked = written(ranked.select(F.col("pos").alias("commit"), "source", "n", epoch.alias("epoch")), f"{folder}/ranked")
    total = ranked.agg(F.sum("n")).first()[0] or 0
    writes = ended.where("by = 'commit'").withColumnRenamed("by_pos", "commit").join(ranked.drop("n").hint("merge"), ["commit", "source"])
    writes = written(writes.select("key", "value", "pos", "source", "commit", "epoch"), f"{folder}/writes")
    undone = written(ended.where("by <> 'commit'").select(F.col("by").alias("kind"), "pos", "by_pos", "key"), f"{folder}/undone")
    drop(spark, *(f"{folder}/{t}" for t in ("log", "read", "ended", "commits", "ranked")))
    return Reassembled(undone, writes, -(-total // per_epoch), folder)


def last_writes(writes: DataFrame, *by: str) -> DataFrame:
    """The write that counts for each key (and by): the last in the order of (commit, pos), as `last` (pos, value)."""
    return writes.groupBy("key", *by).agg(F.max_by(F.struct("pos", "value"), F.struct("commit", "source", "pos", "value")).alias("last"))


def stored(done: Reassembled, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, doc_id and text of what the store holds at the log's end. (Of repeated positions any one's text.)"""
    last = last_writes(done.writes).where("last.value IS NOT NULL").select("key", F.col("last.pos").alias("doc_id"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    return last.join(texts, "doc_id").dropDuplicates(["key"]).select("key", "doc_id", "text")


def states(done: Reassembled) -> DataFrame:
    """epoch, keys, total: after each epoch the number of stored keys and the sum of their values."""
    spark = done.writes.sparkSession
    slices = partitions(done.writes)
    span = max(1, -(-done.epochs // slices))
    sliced = ((F.col("epoch") - 1) / span).cast("long")
    last = last_writes(done.writes, "epoch").select("key", "epoch", F.struct("last.value").alias("now"), sliced.alias("slice"))
    last = written(last, f"{done.folder}/last")
    after = last.groupBy("key", "slice").agg(F.max_by("now", "epoch").alias("after"))  # a key's slices: as many as shuffle partitions
    before = after.select("key", "slice", F.lag("after").over(W.partitionBy("key").orderBy("slice")).alias("before"))
    in_slice = W.partitionBy("key", "slice").orderBy("epoch")
    changed = last.withColumn("lag", F.lag("now").over(in_slice)).join(before, ["key", "slice"]).withColumn("was", F.coalesce("lag", "before"))
    held = lambda c: F.when(F.col(f"{c}.value").isNotNull(), 1).otherwise(0)
    value = lambda c: F.coalesce(F.col(f"{c}.value"), F.lit(0))
    deltas = changed.select("epoch", (held("now") - held("was")).alias("keys"), (value("now") - value("was")).alias("total")).groupBy("epoch").agg(F.sum("keys").alias("keys"), F.sum("total").alias("total"))
    every = spark.range(1, done.epochs + 1, 1, slices).withColumnRenamed("id", "epoch").join(deltas.hint("merge"), "epoch", "left").select("epoch", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("keys", "total")], sliced.alias("slice"))
    every = written(every, f"{done.folder}/deltas")
    out = written(summed(every, "slice", ["epoch"], ["keys", "total"]).select("epoch", F.col("upto_keys").alias("keys"), F.col("upto_total").alias("total")), f"{done.folder}/states")
    drop(spark, f"{done.folder}/last", f"{done.folder}/deltas")
    return out


KEYS = 300
#: Remainders of the hash by 23 that aren't changes.
KINDS = ["commit", "commit", "abort", "savepoint", "savepoint", "rollback", "rollback"]


def document_log(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A documents table as such a log: kind and key by a hash of the id; the value stands for `key:text`, and toxic documents and null texts delete."""
    h = F.crc32(F.col("pos").cast("string").cast("binary"))
    kind = F.coalesce(F.get(F.array(*[F.lit(k) for k in KINDS]), (h % 23).cast("int")), F.lit("change"))
    rows = docs.select(F.col(id_col).cast("long").alias("pos"), F.col(source_col).alias("source"), F.col(text_col).cast("string").alias("text")).where("pos IS NOT NULL")
    rows = rows.select("pos", "source", kind.alias("kind"), (F.floor(h / 100) % KEYS).cast("long").alias("key"), "text")
    change = F.col("kind") == "change"
    rows = rows.select("pos", "source", "kind", F.when(change, F.col("key")).alias("key"), F.when(change, F.crc32(F.concat(F.col("key").cast("string"), F.lit(":"), F.col("text")).cast("binary"))).alias("value"))
    toxic = labels.where("toxic = 1").select(F.col("doc_id").cast("long").alias("pos")).distinct().withColumn("toxic", F.lit(True))
    return rows.join(toxic.hint("merge"), "pos", "left").select("pos", "source", "kind", "key", F.when(F.col("toxic").isNull(), F.col("value")).alias("value"))


def digest(done: Reassembled) -> DataFrame:
    """kind, id, n, value: the state after each epoch, and every undone change with what undid it."""
    state = states(done).select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), F.col("keys").cast("long").alias("n"), F.col("total").alias("value"))
    return state.unionByName(done.undone.select("kind", F.col("pos").alias("id"), F.col("by_pos").alias("n"), F.col("key").alias("value")))
