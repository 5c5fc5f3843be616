"""The tables of the queries: canonical documents, vectors, analysed tables, the change log, and the small catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import segmentation
from ..functions import text as T
from ..functions.analysers import Analyser
from ..operators import ann, compressed, corpus, graph
from ..operators.latent import Latent
from ..operators import index as index_tables
from ..operators.stored import Index, work_folder
from ..operators.substrings import Substrings

TOKENS = ["the", "entre", "para"]
QUERY_VECTOR = 7
#: Lists of the vector index and how many a search probes. The vectors of these tables are nearly without clusters
#: (the tenth neighbour's cosine is 0.3), so a recall of 0.9 takes more than half of the lists.
LISTS, PROBES = 64, 40

LANGUAGES = [("english", "english"), ("korean", "korean"), ("simple", "simple")]
SETTINGS = [("english", 1.2, 0.75), ("korean", 1.5, 0.6), ("simple", 1.2, 0.75)]
TABLES = [("documents", "english", True, True), ("benchmark", "english", False, True), ("pages", "simple", False, True), ("conversations", "simple", False, False)]


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark, d) -> DataFrame:
    return corpus.documents(load(spark, d, "documents"))


def vectors(spark, d) -> DataFrame:
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def query_vector(spark, d, vec_id: int = QUERY_VECTOR) -> DataFrame:
    return vectors(spark, d).where(F.col("id") == vec_id).select(F.col("embedding").alias("q"))


def analysed(spark, d) -> DataFrame:
    return index_tables.analysed(load(spark, d, "documents"), "documents", "doc_id", "text")


def scope(spark, d) -> DataFrame:
    return analysed(spark, d).unionByName(index_tables.analysed(load(spark, d, "benchmark"), "benchmark", "item_id", "text"))


_built: dict[tuple, object] = {}


def built(spark, d, name: str, make):
    """What make(folder) gives, made once a session and input: an index is built before it is searched, and not for each search."""
    import hashlib

    files = spark._jvm.org.apache.hadoop.fs.Path(d)
    stamps = sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in files.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(files))
    key = (spark.sparkContext.applicationId, d, name, tuple(stamps))  # a changed table is indexed anew
    if key not in _built:
        _built[key] = make(work_folder(spark, f"{name}-{hashlib.sha256(repr(key).encode()).hexdigest()[:16]}"))
    return _built[key]


def index(spark, d) -> Index:
    """The stored index of the language: documents and benchmark."""
    texts = index_tables.cleaned(load(spark, d, "documents"), "documents", "doc_id", "text").unionByName(index_tables.cleaned(load(spark, d, "benchmark"), "benchmark", "item_id", "text"))
    return built(spark, d, "index", lambda folder: Index(spark, folder).build(texts))


def stem_index(spark, d) -> Index:
    """The stored index of the documents' English stems."""
    return built(spark, d, "stems", lambda folder: Index(spark, folder).build(Analyser("english").analysed(load(spark, d, "documents"), "documents", "doc_id", "text")))


def lexicon(spark, d) -> segmentation.Lexicon:
    """The pieces of all documents' words, of any script."""
    return built(spark, d, "lexicon", lambda _: segmentation.learn(load(spark, d, "documents"), T.tokens(F.col("text")), segmentation.LETTERS))


def substrings(spark, d) -> Substrings:
    """The trigram lists of the documents."""

    def make(folder):
        out = Substrings(spark, folder)
        out.write(docs(spark, d))
        return out

    return built(spark, d, "substrings", make)


def lists(spark, d) -> ann.Lists:
    """The written vector lists."""
    return built(spark, d, "lists", lambda folder: ann.Lists(spark, folder).build(vectors(spark, d), LISTS))


def graphs(spark, d) -> graph.Graphs:
    """The written graphs of the vectors."""
    return built(spark, d, "graphs", lambda folder: graph.Graphs(spark, folder).build(vectors(spark, d)))


def latent(spark, d) -> Latent:
    """The vectors learned from the documents."""
    return built(spark, d, "latent", lambda folder: Latent(spark, folder).fit(analysed(spark, d)))


def codes(spark, d) -> compressed.Compressed:
    """The written lists of quantised vectors."""
    return built(spark, d, "codes", lambda folder: compressed.Compressed(spark, folder).build(vectors(spark, d)))


def final_state(spark, d) -> DataFrame:
    """The analysed documents after all changes."""
    text = F.when(F.col("doc_id") % 5 == 0, F.expr("left(text, cast(length(text) div 2 as int))")).otherwise(F.col("text"))
    return index_tables.analysed(load(spark, d, "documents").where("doc_id % 7 <> 0").select("doc_id", text.alias("text")), "documents", "doc_id", "text")


def log(spark, d, inserts: bool = True) -> DataFrame:
    """The change log: an insert of every document, an update to the first half of every fifth, a delete of every seventh. One scan."""
    src = load(spark, d, "documents").select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("whole"), T.tokens(F.expr("left(text, cast(length(text) div 2 as int))")).alias("half"))
    none = F.lit(None).cast("array<string>")
    task = lambda kind, when, old, new: F.when(when, F.struct(F.lit(kind).alias("task_type"), old.alias("old_tokens"), new.alias("new_tokens")))
    whole, half, fifth, seventh = F.col("whole"), F.col("half"), F.col("id") % 5 == 0, F.col("id") % 7 == 0
    tasks = [task(1, fifth, whole, half), task(2, seventh, F.when(fifth, half).otherwise(whole), none)]
    if inserts:
        tasks.insert(0, task(0, F.lit(True), none, whole))
    rows = src.select("id", F.explode(F.array_compact(F.array(*tasks))).alias("t")).select("id", "t.*")
    return rows.select((F.col("task_type") * 1_000_000_000 + F.col("id")).alias("row_id"), "task_type", F.lit("documents").alias("table_name"), "id", T.text_length(F.col("old_tokens")).alias("old_len"), "old_tokens", T.text_length(F.col("new_tokens")).alias("new_len"), "new_tokens")


def consolidated(spark, d) -> DataFrame:
    return index_tables.consolidate(log(spark, d, inserts=False))


def languages(spark) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "language string, table_suffix string")


def settings(spark) -> DataFrame:
    return spark.createDataFrame(SETTINGS, "language string, k1 double, b double")


def tables(spark) -> DataFrame:
    return spark.createDataFrame(TABLES, "table_name string, language string, is_default boolean, is_active boolean")


def values(rows, columns: str) -> str:
    """An SQL table of the constants."""
    lit = lambda v: f"'{v}'" if isinstance(v, str) else "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns}))"


SQL_LANGUAGES = values(LANGUAGES, "language, table_suffix")
SQL_SETTINGS = values(SETTINGS, "language, k1, b")
SQL_TABLES = values(TABLES, "table_name, language, is_default, is_active")
