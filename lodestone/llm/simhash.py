"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a few differing bits, found in BK-trees.

1. A fingerprint has a bit where over half of a text's shingle hashes have it; equal fingerprints are one node.
2. The bits are cut into `blocks` blocks. Of two fingerprints that differ in 4 bits at most, all but 4 blocks are equal,
   so each node goes to a shard for each choice of the others, and linked nodes meet in one. The number of blocks follows
   the number of nodes, so that a shard holds few nodes by chance.
3. A task grows a BK-tree for each of its shards, all of them as one forest in numpy arrays: the children of a node are
   keyed by their Hamming distance to it. Each node of a shard is looked up, and only edges within the radius are followed.
   What a task finds leaves it as one link for each node, to the first of its component there.
4. A shard with more than SHARD nodes is cut into pieces, each with a tree of its own. Once components are known, a crowded
   shard's nodes outside its largest component are looked up in the trees of all its pieces; nodes in one component need
   not meet again. So each link between different components is found, and no list of all pairs is made.
5. Components are joined by labels on written tables.

Trees are grown where their shard is dealt to and not sent through the driver, as together they hold the fingerprints of
all documents; a tree has SHARD nodes at most, and those that look it up come to it.

Defined results: null and wordless texts have the fingerprint zero and are linked like any other; with fewer than `k`
words the whole sequence is the one shingle; repeated rows are linked; a null doc_id takes part but never becomes a
component id while its component has another; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .deal import looked_up, partitions
from .jaccard import components
from .runtime import cut, documents, drop, shared_dir, written

#: Nodes of a tree, about.
SHARD = 4096
#: Nodes that a shard holds by chance, at most.
BY_CHANCE = 256
#: Lookups of a forest at once, as many as their trees have together so many nodes.
STEPS = 1 << 20
#: Nodes of a forest, about.
FOREST = 1 << 17
#: Bytes of a text whose words are laid out at once.
PIECE = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def hashes(words: list[bytes], k: int, seed: int) -> list[int]:
    """Of each shingle of k words, joined by spaces."""
    from xxhash import xxh64_intdigest

    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]


def shingle_hashes(text: str | None, k: int = 4, seed: int = 42):
    """Lists of the hashes of all shingles of a text; a long text's by pieces."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    at, tail, some = 0, [], False
    while at < len(data):
        end = len(data) if len(data) - at <= PIECE else m.start() if (m := SPACE.search(data, at + PIECE)) else len(data)
        words = tail + data[at:end].split()
        if len(words) >= k:
            some = True
            yield hashes(words, k, seed)
            tail = words[len(words) - k + 1 :]
        else:
            tail = words
        at = end
    if tail and not some:
        yield hashes(tail, len(tail), seed)


def counts_of(hs: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hs, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(0, dtype=np.int64)


def fingerprints(texts, k: int = 4, seed: int = 42) -> np.ndarray:
    """uint64 fingerprints."""
    counts, sizes = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        for hs in shingle_hashes(text, k, seed):
            counts[i] += counts_of(hs)
            sizes[i] += len(hs)
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


class Forest:
    """BK-trees of groups of fingerprints (a group's in one stretch), the first of each as its root."""

    def __init__(self, values: np.ndarray, group: np.ndarray):
        self.values = values
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(values) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(values)))
        self.root, self.size = np.repeat(first, sizes), np.repeat(sizes, sizes)
        todo = np.setdiff1d(np.arange(len(values)), first, assume_unique=True)
        at, keys, nodes = self.root[todo], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(todo):  # each goes down an edge, or becomes the child at the edge's end
            edge = at * 128 + np.bitwise_count(values[todo] ^ values[at])
            unique, where, inverse = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(unique)
            nodes.append(todo[where])
            left = np.ones(len(todo), bool)
            left[where] = False
            at, todo = todo[where][inverse][left], todo[left]
        order = np.argsort(edges := np.concatenate(keys))
        self.edges, self.nodes = edges[order], np.concatenate(nodes)[order]

    def near(self, values: np.ndarray, roots: np.ndarray, radius: int):
        """(place among the values, node) of all within the radius in the tree of each one's root."""
        who, node, found = np.arange(len(values)), roots, []
        while len(who):
            d = np.bitwise_count(values[who] ^ self.values[node]).astype(np.int64)
            hit = d <= radius
            found.append((who[hit], node[hit]))
            lo = np.searchsorted(self.edges, node * 128 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.edges, node * 128 + np.minimum(d + radius, 64), "right") - lo
            who = np.repeat(who, n)
            node = self.nodes[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(who))]
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def stretches(sizes: np.ndarray, most: int):
    """Bounds of stretches whose sizes add up to about so much at most."""
    part = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]) if len(sizes) else ()


def unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (the least of a component) after links."""
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return label
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def linked(values: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): each value that isn't the first of its component in its group, and that first."""
    forest, label = Forest(values, group), np.arange(len(values))
    for lo, hi in stretches(forest.size, STEPS):
        u, v = forest.near(values[lo:hi], forest.root[lo:hi], radius)
        label = unite(label, u + lo, v)
    other = np.flatnonzero(label != np.arange(len(values)))
    return values[other], values[label[other]]


def links_of(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def within(radius: int):
    """Links in each task's trees; rows (task, fp) come sorted by task."""

    def run(batches):
        task, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            t, f = columns(batch, "task", "fp")
            task, fp = np.append(task, t), np.append(fp, f)
            if len(task) >= FOREST and task[0] != task[-1]:  # the last tree may go on
                n = int(np.flatnonzero(task != task[-1])[-1]) + 1
                yield links_of(*linked(fp[:n].view(np.uint64), task[:n], radius))
                task, fp = task[n:], fp[n:]
        if len(task):
            yield links_of(*linked(fp.view(np.uint64), task, radius))

    return run


def across(radius: int):
    """Links (u, v) between components: rows (task, walks, fp, label) come sorted by task, a tree's nodes before those that look it up."""

    def run(batches):
        now, nodes, labels, forest = None, [], [], None
        for batch in batches:
            task, walks, fp, label = columns(batch, "task", "walks", "fp", "label")
            cuts = np.flatnonzero((np.diff(task) != 0) | (np.diff(walks) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(task)]):
                if task[lo] != now:
                    now, nodes, labels, forest = task[lo], [], [], None
                if not walks[lo]:
                    nodes.append(fp[lo:hi])
                    labels.append(label[lo:hi])
                    continue
                if forest is None:
                    own = np.concatenate(nodes or [np.zeros(0, np.int64)]).view(np.uint64)
                    forest, of = Forest(own, np.zeros(len(own), np.int64)), np.concatenate(labels or [np.zeros(0, np.int64)])
                for a in range(lo, hi, max(1, STEPS // max(1, len(own)))) if len(own) else ():
                    some = slice(a, min(hi, a + max(1, STEPS // len(own))))
                    who, node = forest.near(fp[some].view(np.uint64), np.zeros(some.stop - some.start, np.int64), radius)
                    pairs = np.unique(np.stack([label[some][who], of[node]], 1), axis=0)
                    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
                    if len(pairs):
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return run


def block_masks(blocks: int, radius: int) -> list[int]:
    """For each choice of all but `radius` blocks the bits in them."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(own[i] for i in some) for some in combinations(range(blocks), blocks - radius)]


def block_count(nodes: int, radius: int) -> int:
    """Blocks with which a shard has BY_CHANCE nodes by chance at most."""
    blocks = radius + 1
    while nodes >> (64 * (blocks - radius) // blocks) > BY_CHANCE and blocks < 2 * radius:
        blocks += 1
    return blocks


def fingerprint(df: DataFrame, k: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp of every document."""

    def run(batches):
        for batch in cut(batches, PIECE):
            fp = fingerprints(batch.column("text").to_pylist(), k, seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link(df: DataFrame, k: int = 4, radius: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    spark = df.sparkSession
    folder = shared_dir(spark, "simhash")
    docs = written(fingerprint(df, k, seed, id_col, text_col), f"{folder}/docs")
    nodes = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{folder}/nodes")

    masks = block_masks(block_count(nodes.count(), radius), radius)
    shards = nodes.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)])).alias("shard"))
    sizes = shards.groupBy("shard").agg(F.count("*").alias("m")).where("m > 1")
    sizes = written(sizes.select("shard", F.ceil(F.col("m") / SHARD).alias("pieces")), f"{folder}/sizes")
    shards = written(shards, f"{folder}/shards")
    task = lambda piece: F.xxhash64("shard", piece).alias("task")
    dealt = looked_up(shards, sizes, "shard").select("shard", "pieces", "fp", task(F.pmod(F.xxhash64("fp"), F.col("pieces"))))
    dealt = written(dealt, f"{folder}/dealt")
    by_task = lambda rows, *order: rows.repartition(partitions(rows), "task").sortWithinPartitions("task", *order)
    links = written(by_task(dealt.select("task", "fp"), "fp").mapInArrow(within(radius), "u long, v long"), f"{folder}/links")
    drop(spark, f"{folder}/shards", f"{folder}/sizes")
    labels = components(links, f"{folder}/labels")

    crowded = dealt.where("pieces > 1").join(labels.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    crowded = written(crowded, f"{folder}/crowded")
    if not crowded.isEmpty():
        of_label = crowded.groupBy("shard", "label").agg(F.count("*").alias("n"))
        largest = of_label.groupBy("shard").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("largest")).where("labels > 1").select("shard", "largest")
        open_rows = written(looked_up(crowded, written(largest, f"{folder}/largest"), "shard"), f"{folder}/open")
        walking = open_rows.where("label <> largest").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        walking = walking.select(task("piece"), F.lit(1).alias("walks"), "fp", "label")
        rows = open_rows.select("task", F.lit(0).alias("walks"), "fp", "label").unionByName(walking)
        more = written(by_task(rows, "walks", "fp").mapInArrow(across(radius), "u long, v long"), f"{folder}/more")
        if not more.isEmpty():
            joined = components(more, f"{folder}/joined").select(F.col("node").alias("label"), F.col("label").alias("to"))
            every = nodes.select(F.col("fp").alias("node")).join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
            every = written(every, f"{folder}/every")
            moved = looked_up(every, joined, "label").select("node", F.col("to").alias("label"))
            same = every.join(joined.hint("merge"), "label", "left_anti").select("node", "label")
            labels = written(moved.unionByName(same), f"{folder}/all-labels")
    drop(spark, f"{folder}/dealt", f"{folder}/crowded", f"{folder}/largest", f"{folder}/open", f"{folder}/more", f"{folder}/every", f"{folder}/links")

    named = written(labels.join(nodes.withColumnRenamed("fp", "node").hint("merge"), "node"), f"{folder}/named")
    least = written(named.groupBy("label").agg(F.min("least").alias("first")), f"{folder}/least")
    first = written(looked_up(named, least, "label").select(F.col("node").alias("fp"), "first"), f"{folder}/first")
    own = written(nodes.join(first.hint("merge"), "fp", "left").select("fp", F.coalesce("first", "least").alias("component_id")), f"{folder}/own")
    out = looked_up(docs, own, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = written(out, f"{folder}/result")
    drop(spark, *(f"{folder}/{t}" for t in ("docs", "nodes", "labels", "joined", "all-labels", "named", "least", "first", "own")))
    return out
