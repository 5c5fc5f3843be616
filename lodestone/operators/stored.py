"""The inverted index as stored tables that searches read by token.

An index is a folder of versions: a base with every document, and a version for each batch of
changes since. Tables: postings (lists in segments, see postings.py), dead (the documents that a
version replaces), frequency and lengths (numbers of the base, differences of the versions after it).
A token's row counts if no later version names its document dead; frequencies and lengths are sums. So a
batch writes what it changes and rewrites nothing; `compact` makes a new base now and then, and then `vacuum`
deletes what no search reads any more.

Versions are numbered from the newest one when they are written. A batch's key stays in its marker, so a
batch that comes again after its commit changes nothing, also when the index was compacted in between, and one that
failed before it overwrites what it left.

While there is only a base, word matches and scores are found where the segments lie, without a shuffle; with later versions the
lists of a query's words are decoded and joined with the dead documents.
"""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import index as I
from . import postings as P

SCHEMAS = {
    "postings": P.SCHEMA + ", version int",
    "dead": "table_name string, id long, version int",
    "frequency": "token string, tfdoc long, version int",
    "lengths": "table_name string, recordcount long, sumlen long, version int",
}

#: Words of queries that one pass over the lists looks for, about.
PASS = 1 << 20

_own: str | None = None


def work_folder(spark: SparkSession, name: str) -> str:
    """A folder below spark.checkpoint.dir, which the driver and all executors see; only a local master does without that setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        global _own
        _own = _own or "file://" + tempfile.mkdtemp(prefix="lodestone-")
        top = _own
    return f"{top.rstrip('/')}/{name}"


class Index:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._stats: tuple = ((-1, -1), {})

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _markers(self) -> list[tuple[int, bool, str]]:
        """(version, whether it is a base, key of its batch) of what is whole."""
        fs, p = self._fs("done")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        parts = [n.removeprefix("base-").partition(".") for n in names]
        return sorted((int(v), n.startswith("base-"), key) for n, (v, _, key) in zip(names, parts))

    def versions(self) -> tuple[int, int]:
        """The newest base and the newest version; -1 if there is none."""
        found = self._markers()
        return max((v for v, base, _ in found if base), default=-1), max((v for v, _, _ in found), default=-1)

    def _done(self, name: str) -> None:
        fs, p = self._fs(f"done/{name}")
        fs.create(p, True).close()

    def _write(self, table: str, version: int, df: DataFrame) -> None:
        path = f"{self.folder}/{table}/version={version}"
        if table == "postings":
            P.write(df, path)
        elif table == "frequency":
            df.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(path)
        else:
            df.write.mode("overwrite").parquet(path)

    def _base(self, docs: DataFrame, version: int) -> None:
        """Documents are analysed once; frequencies and lengths come from the written lists."""
        self._write("postings", version, docs)
        lists = self._read("postings", version, version)
        self._write("frequency", version, lists.where("token <> ''").groupBy("token").agg(F.sum("n").alias("tfdoc")))
        self._write("lengths", version, self._lengths(lists))
        self._done(f"base-{version}")

    @staticmethod
    def _lengths(lists: DataFrame) -> DataFrame:
        import pyarrow as pa

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([int(np.frombuffer(x, np.int32).sum()) for x in b.column(2).to_pylist()], pa.int64())], names=["table_name", "n", "len"])

        sums = lists.where("token = ''").select("table_name", "n", "tfs").mapInArrow(run, "table_name string, n long, len long")
        return sums.groupBy("table_name").agg(F.sum("n").alias("recordcount"), F.sum("len").alias("sumlen"))

    def applied(self) -> int | None:
        """The row_id up to which the change log is in the index, from the markers of its batches."""
        return max((int(key[3:]) for _, _, key in self._markers() if key.startswith("to-")), default=None)

    def build(self, docs: DataFrame, version: int | None = None) -> Index:
        """A base of all analysed documents (table_name, id, tokens, len) or cleaned ones (table_name, id, tokens as text), as the next version; one below or at the newest is refused."""
        last = self.versions()[1]
        version = last + 1 if version is None else version
        if version <= last:
            raise ValueError(f"version {version} isn't above the newest, {last}")
        self._base(docs, version)
        return self

    def apply(self, log: DataFrame, batch: str | None = None) -> int:
        """A batch of the change log as the next version; gives its number, or that of the version that already holds the batch."""
        found = self._markers()
        if not any(base for _, base, _ in found):
            raise ValueError(f"{self.folder} has no base")
        if batch is not None and (known := [v for v, _, key in found if key == batch]):
            return known[0]
        version = found[-1][0] + 1
        tasks = I.consolidate(log).persist()
        try:
            final = tasks.where("final_tokens IS NOT NULL").select(*I.KEY, F.col("final_tokens").alias("tokens"), F.coalesce("final_len", F.lit(0)).cast("int").alias("len"))
            self._write("postings", version, final)
            self._write("dead", version, tasks.select(*I.KEY))
            self._write("frequency", version, I.df_deltas(tasks).select("token", F.col("delta").alias("tfdoc")))
            self._write("lengths", version, I.length_deltas(tasks).select("table_name", F.col("record_delta").cast("long").alias("recordcount"), F.col("sumlen_delta").alias("sumlen")))
        finally:
            tasks.unpersist()
        self._done(f"{version}.{batch}" if batch is not None else f"{version}")
        return version

    def compact(self) -> int:
        """A new base from all that counts now."""
        version = self.versions()[1] + 1
        rows = self._rows(None, None, "")
        tokens = F.array_repeat("token", F.when(F.col("token") == "", 0).otherwise(F.col("tf")).cast("int"))
        docs = rows.groupBy(*I.KEY).agg(F.flatten(F.collect_list(tokens)).alias("tokens"), F.first("len").alias("len"))  # a document's own words
        self._write("postings", version, docs)
        self._write("frequency", version, self.frequency())
        self._write("lengths", version, self.lengths().select("table_name", "recordcount", "sumlen"))
        self._done(f"base-{version}")
        return version

    def vacuum(self) -> None:
        """Deletes the tables of versions before the newest base; no search may be running. Their markers stay, as they know the batches."""
        for version in range(self.versions()[0]):
            for table in SCHEMAS:
                fs, p = self._fs(f"{table}/version={version}")
                fs.delete(p, True)

    def _read(self, table: str, first: int, last: int) -> DataFrame | None:
        paths = [f"{self.folder}/{table}/version={v}" for v in range(first, last + 1)]
        return self.spark.read.schema(SCHEMAS[table]).option("basePath", f"{self.folder}/{table}").parquet(*paths) if paths else None

    def _rows(self, words: list[str] | None, table: str | None, empty: str | None = None) -> DataFrame:
        """Decoded rows of what counts now; with `empty` also a row with that token and tf 1 for each document."""
        base, last = self.versions()
        out = None
        for version in range(base, last + 1):
            rows = self._read("postings", version, version)
            rows = P.selected(rows, words, table) if words is not None else rows if table is None else rows.where(F.col("table_name") == table)
            one = P.decoded(rows, empty).withColumn("version", F.lit(version))
            out = one if out is None else out.unionByName(one)
        if (dead := self._read("dead", base + 1, last)) is not None:
            gone = dead.groupBy(*I.KEY).agg(F.max("version").alias("gone"))
            out = out.join(gone, I.KEY, "left").where("gone IS NULL OR version >= gone")
        return out.select(*I.KEY, "token", "tf", "len")

    def tokens(self, words: list[str] | None = None, table: str | None = None) -> DataFrame:
        """table_name, id, token, tf, len of what counts now; with words only theirs."""
        return self._rows(words, table)

    def _lists(self) -> DataFrame | None:
        """The lists, if all that counts is in a base."""
        base, last = self.versions()
        return self._read("postings", base, base) if base == last else None

    def frequency(self, words: list[str] | None = None) -> DataFrame:
        """token, tfdoc; tokens that no document has any more are left out."""
        base, last = self.versions()
        rows = self._read("frequency", base, last)
        rows = rows if words is None else rows.where(F.col("token").isin(words))
        if base == last:
            return rows.select("token", "tfdoc")
        return rows.groupBy("token").agg(F.sum("tfdoc").alias("tfdoc")).where("tfdoc > 0")

    def lengths(self) -> DataFrame:
        rows = self._read("lengths", *self.versions()).groupBy("table_name").agg(*[F.greatest(F.lit(0), F.sum(c)).cast("long").alias(c) for c in ("recordcount", "sumlen")])
        return rows.withColumn("avglen", F.when(F.col("recordcount") > 0, F.col("sumlen") / F.nullif(F.col("recordcount"), F.lit(0))).otherwise(0.0))

    def stats(self) -> dict[str, tuple[int, float]]:
        """recordcount and avglen by table, of the newest version: a row a managed table, read once a version."""
        at = self.versions()
        if self._stats[0] != at:
            self._stats = at, {r.table_name: (r.recordcount, r.avglen) for r in self.lengths().collect()}
        return self._stats[1]

    def usage(self) -> DataFrame:
        """table, rows: what the index holds now, as rows of its tables."""
        out = None
        lists = self._lists()
        tokens = self.tokens().agg(F.count("*").alias("rows")) if lists is None else lists.where("token <> ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
        for name, rows in (("tokens", tokens), ("frequency", self.frequency().agg(F.count("*").alias("rows"))), ("lengths", self.lengths().agg(F.count("*").alias("rows")))):
            one = rows.select(F.lit(name).alias("table"), "rows")
            out = one if out is None else out.unionByName(one)
        return out

    def matching(self, words: list[str], table: str) -> DataFrame:
        """The ids of the documents that have all the words; none for no words."""
        words = list(dict.fromkeys(words))
        if words and (lists := self._lists()) is not None:
            return P.matching(lists, words, table)
        return self.tokens(words, table).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(words)).select("id")

    def _weights(self, words: list[str], table: str, k1: float, b: float) -> P.Weights:
        found = {r.token: r.tfdoc for r in self.frequency(list(dict.fromkeys(words))).collect()}  # a row a word
        stats = self.stats()
        n = sum(c for c, _ in stats.values())
        return P.Weights({w: P.idf(n, found[w]) for w in dict.fromkeys(words) if w in found}, stats.get(table, (0, 0.0))[1], k1, b)

    def score(self, words: list[str], table: str, k1: float = 1.2, b: float = 0.75, ids: list[int] | None = None, digits: int = 6) -> DataFrame:
        """id and BM25 score of the documents that have a word, or of those among them with these ids."""
        weights = self._weights(words, table, k1, b)
        if (lists := self._lists()) is not None:
            return P.scored(lists, weights, table, ids).withColumn("score", F.round("score", digits))
        rows = self.tokens(list(weights.idf), table)
        rows = rows if ids is None else rows.where(F.col("id").isin(ids))
        of = F.lit(None).cast("double")
        for word, x in weights.idf.items():
            of = F.when(F.col("token") == word, F.lit(x)).otherwise(of)
        k1, b = weights.k1, weights.b
        term = of * (F.col("tf") * round(k1 + 1, 6)) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.nullif(F.lit(float(weights.avglen)), F.lit(0.0))))
        return rows.groupBy("id").agg(F.round(F.coalesce(F.sum(term), F.lit(0.0)), digits).alias("score"))

    def top(self, words: list[str], table: str, k: int, k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
        """The best k by score, then id: each task skips the blocks of its lists that can't be among them, and only the tasks' best are merged."""
        if (lists := self._lists()) is None:
            found = self.score(words, table, k1, b, digits=digits)
        else:
            found = P.tops(lists, self._weights(words, table, k1, b), table, k, digits).where("id IS NOT NULL").select("id", F.round("score", digits).alias("score"))
        return found.orderBy(F.desc("score"), F.desc("id")).limit(k)

    def skipped(self, words: list[str], table: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """blocks, blocks_read: of the lists of a query's words in the base."""
        lists = self._read("postings", *[self.versions()[0]] * 2)
        return P.tops(lists, self._weights(words, table, k1, b), table, k).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("blocks", "blocks_read")])

    def top_many(self, queries: DataFrame, table: str, k: int, k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
        """query_id, place, id, score: the best k of each of many queries (query_id, words array), by score, then id.

        Rows that share a query_id are one query, and queries of the same words are searched for once. These sets of words are dealt to blocks of about PASS words; a block's words are looked for in two passes
        over the lists, the first for a bound of each k-th score, and only each task's best k are shuffled. Null words, a null array and words
        that no document has find nothing. A block's result is written before the next block starts.
        """
        folder = work_folder(self.spark, f"queries-{uuid.uuid4().hex}")
        words = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode("words").alias("token")).where("token <> ''")
        words = words.groupBy("query_id").agg(F.array_sort(F.collect_set("token")).alias("words"))
        words.write.mode("overwrite").parquet(f"{folder}/words")
        words = self.spark.read.schema(words.schema).parquet(f"{folder}/words")
        sets = words.groupBy("words").agg(F.min("query_id").alias("set_id"))  # null only where a null query_id has these words alone
        sets.write.mode("overwrite").parquet(f"{folder}/sets")
        sets = self.spark.read.schema(sets.schema).parquet(f"{folder}/sets")
        blocks = max(1, -(-(sets.agg(F.sum(F.size("words"))).first()[0] or 0) // PASS))
        stats = self.stats()
        n, avglen = sum(c for c, _ in stats.values()), stats.get(table, (0, 0.0))[1]
        for block in range(blocks):
            own = sets.where(F.pmod(F.xxhash64("set_id"), F.lit(blocks)) == block).select("set_id", F.explode("words").alias("token"))
            tokens = own.select("token").distinct()
            found = self.frequency().join(F.broadcast(tokens), "token", "left_semi").toArrow().sort_by("token")  # about PASS rows at most
            df = found.column("tfdoc").to_numpy()
            weights = P.Weights({w: P.idf(n, x) for w, x in zip(found.column("token").to_pylist(), df.tolist())}, avglen, k1, b)
            if (lists := self._lists()) is not None:
                many = self._asked(own, found.column("token"), df, 16 * k)
                wanted = tokens.unionByName(self.spark.range(1).select(F.lit("").alias("token")))
                lists = lists.join(F.broadcast(wanted), "token", "left_semi")
                best = W.partitionBy("query_id").orderBy(F.desc("score"))
                reached = P.tops_many(lists, many, weights, table, k, digits).withColumn("place", F.row_number().over(best)).where(F.col("place") == k)
                reached = {r["query_id"]: r["score"] for r in reached.select("query_id", "score").collect()}  # a row a set of the block
                least = np.array([reached.get(q, -math.inf) for q in many.ids])
                found = P.tops_many(lists, many, weights, table, k, digits, least)
            else:
                found = self._scored_many(own.withColumnRenamed("set_id", "query_id"), tokens, weights, n, table)
            found = found.withColumn("score", F.round("score", digits))
            place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("id")))
            found.withColumn("place", place.cast("long")).where(F.col("place") <= k).select(F.col("query_id").alias("set_id"), "place", "id", "score").write.mode("overwrite").parquet(f"{folder}/found/block={block}")
        found = self.spark.read.schema("set_id long, place long, id long, score double").parquet(*[f"{folder}/found/block={x}" for x in range(blocks)])
        asked = words.join(sets, "words").select("query_id", F.col("set_id").alias("own"))
        return found.join(asked, F.col("set_id").eqNullSafe(F.col("own"))).select("query_id", "place", "id", "score")

    @staticmethod
    def _asked(own: DataFrame, tokens, df: np.ndarray, seeds: int) -> P.Asked:
        """The sets of a block with the words that documents have, as numbers."""
        import pyarrow.compute as pc

        pairs = own.toArrow()  # about PASS rows
        word = pc.index_in(pairs.column("token"), value_set=tokens.combine_chunks())
        pairs, word = pairs.filter(pc.is_valid(word)).column("set_id").combine_chunks(), word.drop_null().to_numpy()
        ids = pairs.dictionary_encode("encode")
        query = ids.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(query, kind="stable")
        return P.Asked.of(ids.dictionary.to_pylist(), tokens.to_pylist(), query[order].astype(np.int32), word[order].astype(np.int32), df, seeds)

    def _scored_many(self, own: DataFrame, tokens: DataFrame, weights: P.Weights, n: int, table: str) -> DataFrame:
        """query_id, id, score by joins, where versions after the base count. Sides of a block's words are broadcast."""
        k1, b = weights.k1, weights.b
        rows = self._rows(None, table).join(F.broadcast(tokens), "token", "left_semi")
        idf = self.frequency().join(F.broadcast(tokens), "token", "left_semi").select("token", F.log(1 + (F.lit(n) - F.col("tfdoc") + 0.5) / (F.col("tfdoc") + 0.5)).alias("idf"))
        term = F.col("idf") * (F.col("tf") * round(k1 + 1, 6)) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.nullif(F.lit(float(weights.avglen)), F.lit(0.0))))
        both = rows.join(F.broadcast(own.select("query_id", "token").join(F.broadcast(idf), "token")), "token")
        return both.groupBy("query_id", "id").agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("score"))
