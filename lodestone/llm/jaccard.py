"""N-gram Jaccard join with prefix trees: all links between documents whose sets of word shingles
have a Jaccard similarity of 0.8 or more, as one component id per document.

1. Every text becomes a set of shingle hashes; equal sets are one node (a 96-bit fingerprint).
2. Shingles have one global order: rare before frequent (a count sketch of fixed size over all
   documents gives coarse tiers), then by hash. The first l shingles that two linked sets share are
   within the first n - ceil(0.8 n) + l of each, so with prefixes of that length (l grows with n) they
   share l of them. Shingles that only one node's prefix holds are dropped, then nodes with too few
   shingles left to link with anything; what remains leads from node to node.
3. Nodes that share prefix shingles are dealt to tasks by a label that spreads two steps along shared
   shingles; a label with many nodes is cut into tasks of a bounded size. A task stores its ordered
   sets in a trie with compressed edges and walks it for each set: sets below a node share the
   overlap counted on the way, and a subtree is left as soon as the remaining lengths can't reach
   the threshold.
4. Nodes that share a prefix shingle, are in different components so far and were in different tasks
   are tested next: each node that isn't in the largest component around a shingle walks the tries of
   the other tasks. So no link between different components is lost, no list of all pairs is made,
   and members of one component are not compared again.
5. Links between components are joined by labels with pointer jumping, on written tables.

Defined results: null and wordless texts have an empty set and are their own component; with fewer
than `k` words the whole sequence is the one shingle; repeated rows are linked (equal sets); a null
doc_id takes part but never becomes a component id; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import sums
from .rolling import Batch, shingles
from .runtime import BATCH_BYTES, cut, documents, drop, forget, shared_dir, small, written

SKETCH = 1 << 20
#: Most sets in a trie, about.
TASK_SETS = 1024
#: Elements of an edge that are looked at between two tests of the bound.
EDGE = 64
SID = ["a", "b"]
#: Bytes of text laid out at once.
BYTES = BATCH_BYTES // 4


def sets_of(texts, k: int):
    """Per text its sorted distinct shingle hashes."""
    h, bounds = shingles(Batch(texts, lower=True), k)
    return [h[lo:hi] for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """96 bits of the set, as a long and an int."""
    d = hashlib.blake2b(s.tobytes(), digest_size=12).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def ordered(s: np.ndarray, tiers: np.ndarray) -> np.ndarray:
    """The set in the global order: by tier, then hash."""
    t = tiers[slot(s)]
    return s[np.argsort(t, kind="stable")] if t.any() else s


#: Hundredths of a set by which prefixes are longer than the least that linked sets must share one shingle of.
LONGER = 15


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 + LONGER * n // 100


def least_shared(n: str, num: int, den: int):
    """Shingles that a set of n and any set it links with share within their prefixes; the other has num / den of n at least."""
    return F.floor(LONGER * F.ceil(F.col(n) * num / den) / 100) + 1


def describe(df: DataFrame, k: int, path: str) -> DataFrame:
    """Written rows of documents (doc_id, th, n, a, b) and of the count sketch (part, counts)."""

    names = ["doc_id", "th", "n", "a", "b", "part", "counts"]

    def run(batches):
        forget()
        sketch = np.zeros(SKETCH, np.uint32)
        for b in cut(batches, BYTES):
            rows = []
            for s in sets_of(b.column("text").to_pylist(), k):
                rows.append((len(s), *fingerprint(s)))
                np.add.at(sketch, slot(s), 1)
            m = len(rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32()))), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        if (parts := sums.packed(sketch)) is not None:
            m = parts.num_rows
            yield pa.RecordBatch.from_arrays([*(pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())), *parts.columns], names=names)

    return written(df.mapInArrow(run, "doc_id long, th long, n long, a long, b int, part int, counts binary"), path)


def tiers_of(counts: np.ndarray) -> np.ndarray:
    """0 for counters within the noise of the sketch, else 1 and up by powers of 2 above it."""
    mean = counts.mean()
    edge = mean + 5 * np.sqrt(mean) + 4
    with np.errstate(divide="ignore"):
        return np.where(counts > edge, 1 + np.log2(np.maximum(counts, 1) / edge), 0).astype(np.uint8)


def prefixes(df: DataFrame, k: int, tiers, num: int, den: int, known=None) -> DataFrame:
    """(h, a, b) of the prefix shingles of every text, or of those that may be in the map known; equal sets of a batch once."""

    def run(batches):
        for batch in cut(batches, BYTES):
            seen, hs, sid, sizes = set(), [], [], []
            for s in sets_of(batch.column("text").to_pylist(), k):
                if len(s) and (f := fingerprint(s)) not in seen:
                    seen.add(f)
                    first = ordered(s, tiers.value)[: prefix_length(len(s), num, den)]
                    hs.append(first if known is None else first[sums.marked(known.value, first)])
                    sid.append(f)
                    sizes.append(len(hs[-1]))
            if hs:
                a, b = (np.repeat(np.array(c, t), sizes) for c, t in zip(zip(*sid), (np.int64, np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(a), pa.array(b)], names=["h", *SID])

    return df.mapInArrow(run, "h long, a long, b int")


class Trie:
    """Ordered sets of small integers (ranks in the task's order), with edges of many elements.

    A node is [elements, children by first element, sets that end here, shortest set below, longest set below].
    """

    def __init__(self, num: int = 4, den: int = 5):
        self.root, self.num, self.den = [np.zeros(0, np.int64), {}, [], 1 << 60, 0], num, den

    def insert(self, s: np.ndarray, name) -> None:
        node, at, n = self.root, 0, len(s)
        while True:
            node[3], node[4] = min(node[3], n), max(node[4], n)
            if at == n:
                node[2].append(name)
                return
            child = node[1].get(int(s[at]))
            if child is None:
                node[1][int(s[at])] = [s[at:], {}, [name], n, n]
                return
            m = min(len(child[0]), n - at)
            differ = np.flatnonzero(child[0][:m] != s[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(child[0]):  # cut the edge
                lower = [child[0][same:], child[1], child[2], child[3], child[4]]
                child[:] = [child[0][:same], {int(lower[0][0]): lower}, [], child[3], child[4]]
            node, at = child, at + same

    def search(self, s: np.ndarray, inside: np.ndarray, upto: np.ndarray):
        """(name, overlap) of the sets that link with s. inside[e]: e is in s; upto[e]: elements of s that are e or before it.

        A subtree is left before its edge is looked at if the elements of s from the edge's first on are too few, and
        within an edge as soon as the elements that are left are.
        """
        n, num, both = len(s), self.num, self.num + self.den
        stack = [(self.root, 0, 0)]
        while stack:
            node, depth, overlap = stack.pop()
            edge, shortest, longest = node[0], node[3], node[4]
            for lo in range(0, len(edge), EDGE):
                part = edge[lo : lo + EDGE]
                overlap += int(np.count_nonzero(inside[part]))
                depth += len(part)
                if both * (overlap + min(n - int(upto[part[-1]]), longest - depth)) < num * (n + max(shortest, depth)):
                    break
            else:
                if node[2] and both * overlap >= num * (n + depth):
                    yield from ((name, overlap) for name in node[2])
                for e, child in node[1].items():
                    if both * (overlap + min(n - int(upto[e]) + int(inside[e]), child[4] - depth)) >= num * (n + max(child[3], depth + len(child[0]))):
                        stack.append((child, depth, overlap))


def ranks(sets: list[np.ndarray], tiers: np.ndarray) -> tuple[list[np.ndarray], int]:
    """The sets as ascending ranks in the order of (tier, hash) among all their elements."""
    every = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    rank = np.empty(len(every), np.int64)
    rank[np.argsort(tiers[slot(every)], kind="stable")] = np.arange(len(every))
    return [np.sort(rank[np.searchsorted(every, s)]) for s in sets], len(every)


def walk(sets: list[np.ndarray], in_trie: list[bool], probes: list[bool], tiers: np.ndarray, num: int, den: int):
    """(probe, set in the trie) for every link; a set that is both is only compared with those before it."""
    by_rank, size = ranks(sets, tiers)
    trie, inside = Trie(num, den), np.zeros(size, bool)
    first = [i for i, (t, p) in enumerate(zip(in_trie, probes)) if t and not p]
    for i in first:
        trie.insert(by_rank[i], i)
    for i, s in enumerate(by_rank):
        if probes[i]:
            inside[s] = True
            mark = np.zeros(size, np.int64)
            mark[s] = 1
            for other, _ in trie.search(s, inside, np.cumsum(mark)):
                yield i, other
            inside[s] = False
            if in_trie[i]:
                trie.insert(s, i)


class Groups:
    """Union-find."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


def by_task(batches):
    """The rows of each task, in one list of dicts; rows arrive sorted by task."""
    rows, task = [], None
    for b in batches:
        for r in b.to_pylist():
            if rows and r["task"] != task:
                yield rows
                rows = []
            task = r["task"]
            rows.append(r)
    if rows:
        yield rows


def sets_in(rows):
    return [np.frombuffer(r["shingles"], np.uint64) for r in rows]


def grouped(df: DataFrame, fn, schema: str) -> DataFrame:
    return df.repartition("task").sortWithinPartitions("task").mapInArrow(fn, schema)


def within(nodes: DataFrame, tiers, num: int, den: int) -> DataFrame:
    """Per node its component among the nodes of its task. nodes: task, a, b, shingles."""

    def run(batches):
        for rows in by_task(batches):
            rows = list({(r["a"], r["b"]): r for r in rows}.values())  # rows with one doc_id may bring a set twice
            groups, all_of = Groups(), [True] * len(rows)
            for i, j in walk(sets_in(rows), all_of, all_of, tiers.value, num, den):
                groups.join(i, j)
            root = [rows[groups.find(i)] for i in range(len(rows))]
            yield pa.RecordBatch.from_arrays([pa.array([r["task"] for r in rows]), *(pa.array([r[c] for r in rows], t) for c, t in zip(SID, (pa.int64(), pa.int32()))), pa.array([f"{r['a'] & (1 << 64) - 1:016x}{r['b'] & (1 << 32) - 1:08x}" for r in root])], names=["task", *SID, "comp"])

    return grouped(nodes, run, "task string, a long, b int, comp string")


def across(rows: DataFrame, tiers, num: int, den: int) -> DataFrame:
    """Links (u, v) between components. rows: task, shingles, comp, probe (whether the set walks the trie or is in it)."""

    def run(batches):
        for got in by_task(batches):
            groups, links = Groups(), []
            probe = [r["probe"] for r in got]
            for i, j in walk(sets_in(got), [not p for p in probe], probe, tiers.value, num, den):
                if groups.join(got[i]["comp"], got[j]["comp"]):
                    links.append((got[i]["comp"], got[j]["comp"]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*links)], names=["u", "v"])

    return grouped(rows, run, "u string, v string")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label): the smallest node that edges (u, v) lead to, for each node with an edge."""
    both = written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{folder}/both")
    labels, step = written(both.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node")), f"{folder}/labels-0"), 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("u") == F.col("node")).select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        jump = hooked.groupBy("before").agg(F.min("label").alias("to"))  # what the old label's group has found
        new = written(hooked.join(jump, "before").select("node", "before", F.least("label", "to").alias("label")), f"{folder}/labels-{step}")
        if new.where("label <> before").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def hexed():
    return F.concat(F.lpad(F.lower(F.hex("a")), 16, "0"), F.lower(F.substring(F.lpad(F.hex(F.col("b").cast("long")), 16, "0"), 9, 8)))


def link(df: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document; threshold num / den."""
    spark = df.sparkSession
    folder = shared_dir(spark, "jaccard")
    texts = documents(df, id_col, text_col).withColumn("th", F.xxhash64("text"))
    described = describe(texts, k, f"{folder}/described")
    docs = described.where("a IS NOT NULL").select("doc_id", "th", "n", *SID)
    tiers = spark.sparkContext.broadcast(tiers_of(sums.summed(described.where("part IS NOT NULL").select("part", "counts"), SKETCH)))
    # A row a set, summed on the map side. th is that of a text with this doc_id: texts that differ in case or white space can have equal sets.
    every = docs.where("n > 0").groupBy(*SID).agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.coalesce(F.min_by("th", "doc_id"), F.min("th")).alias("th"))
    every = written(every, f"{folder}/sets")

    texts_of = texts.select("text")
    shared = prefixes(texts_of, k, tiers, num, den).groupBy("h").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low <> high").select("h")
    shared = written(shared, f"{folder}/shared")
    seen = spark.sparkContext.broadcast(sums.bitmap(shared, "h"))
    rows = written(prefixes(texts_of, k, tiers, num, den, seen).join(shared, "h", "left_semi").distinct(), f"{folder}/rows")
    first = written(every.join(rows.groupBy(*SID).agg(F.count("*").alias("c")), SID).withColumn("need", least_shared("n", num, den)).where("c >= need").withColumn("smaller", F.ceil(F.col("n") * num / den)).withColumn("fewer", least_shared("smaller", num, den)).select(*SID, "doc_id", "th", "need", "fewer"), f"{folder}/first")
    paths = written(rows.join(small(first.select(*SID)), SID, "left_semi"), f"{folder}/paths")
    drop(spark, f"{folder}/shared", f"{folder}/rows")

    home = paths.groupBy(*SID).agg(F.min(F.xxhash64("h")).alias("home"))
    near = written(paths.join(home, SID).groupBy("h").agg(F.min("home").alias("hub")), f"{folder}/near")
    hub = written(paths.join(small(near), "h").groupBy(*SID).agg(F.min("hub").alias("hub")), f"{folder}/hubs")
    size = written(hub.groupBy("hub").agg(F.count("*").alias("m")), f"{folder}/sizes")
    part = F.pmod(F.xxhash64(*SID), F.ceil(F.col("m") / TASK_SETS))
    tasks = hub.join(small(size), "hub").select(*SID, F.concat_ws(":", "hub", part).alias("task"))
    asked = written(tasks.join(first.select(*SID, "doc_id", "th"), SID), f"{folder}/asked")
    nodes = written(keyed_sets(texts, small(asked), k), f"{folder}/nodes")
    comps = written(within(nodes, tiers, num, den), f"{folder}/components")
    drop(spark, *(f"{folder}/{t}" for t in ("near", "hubs", "sizes", "asked")))

    edges = written(across(probes(paths, comps, nodes, first, folder), tiers, num, den), f"{folder}/links")
    labels = components(edges, f"{folder}/labels")
    label = comps.join(small(labels), F.col("node") == F.col("comp"), "left").select(*SID, F.coalesce("label", "comp").alias("label"))
    label = written(label.join(every.select(*SID, "doc_id"), SID), f"{folder}/label")  # a row a set; a label can have very many
    least = written(label.groupBy("label").agg(F.min("doc_id").alias("least")), f"{folder}/least")
    linked = written(label.join(small(least), "label").select(*SID, "least"), f"{folder}/linked")
    own = written(every.join(small(linked), SID, "left").select(*SID, F.coalesce("least", "doc_id").alias("least")), f"{folder}/own")
    drop(spark, *(f"{folder}/{t}" for t in ("sets", "first", "paths", "nodes", "components", "links", "labels", "label", "least", "linked", "known", "spread", "walks", "parts", "walking", "tries")))
    return docs.join(small(own), SID, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keyed_sets(texts: DataFrame, tasks: DataFrame, k: int) -> DataFrame:
    """task, a, b, shingles of each node, from a text that has its set. tasks: a, b, task, doc_id, th.

    The text is found by its hash and doc_id. Where rows share both, each task of this step makes the set once.
    """

    def run(batches):
        made = set()
        for batch in cut(batches, BYTES):
            names = list(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()))
            new = [i for i, f in enumerate(names) if f not in made]
            new = list({names[i]: i for i in new}.values())
            keep, sets = [], []
            for i, s in zip(new, sets_of([batch.column("text")[i].as_py() for i in new], k)):
                if fingerprint(s) == names[i]:  # else another text with this hash
                    keep.append(i)
                    sets.append(s.tobytes())
                    made.add(names[i])
            part = batch.select(["task", *SID]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sets, pa.binary())], names=["task", *SID, "shingles"])

    asked = tasks.select("task", *SID, F.col("doc_id").alias("of"), F.col("th").alias("of_th"))
    joined = texts.join(asked, (F.col("th") == F.col("of_th")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("task", *SID, "text")
    return joined.mapInArrow(run, "task string, a long, b int, shingles binary")


def probes(paths: DataFrame, comps: DataFrame, nodes: DataFrame, first: DataFrame, folder: str) -> DataFrame:
    """The rows of `across`: tries of the tasks that are to be walked again, and the sets that walk them.

    Two nodes that link share `need` prefix shingles or more, and if they are in different components all of these are
    open (have nodes of two components). Open shingles have one order, rare before frequent. The first `half` that the
    two share are among the first c - need + half of each one's c, so only those lead from node to node, and the most
    frequent ones, that very many nodes have, don't. Around a shingle, nodes of the largest component needn't walk, the
    others walk to them; and of two nodes in different components one at least isn't in the largest. So one of the two
    isn't for half of the shingles, and it is enough that a node walks the trie of another task if so many of its
    shingles lead to nodes there outside its component. The other set can be smaller by the threshold; then it needs fewer.
    """
    known = written(paths.join(comps, SID), f"{folder}/known")
    sizes = known.groupBy("h", "comp").agg(F.count("*").alias("n"))
    spread = sizes.groupBy("h").agg(F.count("*").alias("comps"), F.sum("n").alias("m"), F.max_by("comp", F.struct("n", "comp")).alias("largest")).where("comps > 1")
    spread = written(spread.select("h", "m", "largest"), f"{folder}/spread")
    by_node = W.partitionBy(*SID)
    ranked = known.join(small(spread), "h").withColumn("c", F.count("*").over(by_node)).withColumn("place", F.row_number().over(by_node.orderBy("m", "h")))
    ranked = ranked.join(small(first.select(*SID, "need", "fewer")), SID).where("place <= c - need + ceil(need / 2)")
    open_rows = written(ranked.select("h", *SID, "comp", "task", "largest", "fewer"), f"{folder}/open")
    other = open_rows.groupBy("h", F.col("task").alias("other")).agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    other = written(other, f"{folder}/others")
    walks = open_rows.where("comp <> largest").join(small(other), "h").where("other <> task AND NOT (low = comp AND high = comp)")
    walks = walks.groupBy(*SID, "comp", F.col("other").alias("trie")).agg(F.count("*").alias("n"), F.first("fewer").alias("fewer"))
    walks = written(walks.where("2 * n >= ceil(fewer / 2)").select(*SID, "comp", "trie"), f"{folder}/walks")
    drop(walks.sparkSession, f"{folder}/open", f"{folder}/others", f"{folder}/known", f"{folder}/spread")
    parts = written(walks.groupBy("trie").agg(F.ceil(2 * F.count("*") / TASK_SETS).alias("parts")), f"{folder}/parts")
    part = F.concat_ws("/", "trie", F.pmod(F.xxhash64(*SID), F.col("parts")))
    walking = written(walks.join(small(parts), "trie").select(*SID, "comp", part.alias("task")), f"{folder}/walking")
    walking = nodes.drop("task").join(small(walking), SID).select("task", "shingles", "comp", F.lit(True).alias("probe"))
    tries = written(comps.join(small(parts), F.col("trie") == F.col("task"), "left_semi").select(*SID, "comp"), f"{folder}/tries")
    tries = nodes.join(small(tries), SID).join(small(parts), F.col("trie") == F.col("task")).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return walking.unionByName(tries.select(F.concat_ws("/", "trie", "p").alias("task"), "shingles", "comp", F.lit(False).alias("probe")))
