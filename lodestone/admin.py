"""Administration: registered tables, settings, documents and their change log, back-fill and indexing runs.

State is small (a row a managed table) and kept as JSON; documents are versions (`store.Corpus`), the
change log is a folder of files that the indexing run reads as a stream, and the index is `stored.Index`.
A run tells its progress as events, can be cancelled between chunks and goes on where it stopped.
"""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vector as V
from .operators import backfill, catalog, index
from .operators.corpus import content_hash, unique_suffix
from .operators.store import Corpus, Files
from .operators.stored import Index
from .streaming import changes

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
HOME = "documents"
LANGUAGES = ("simple", "english", "korean", "japanese", "chinese")
#: A registration's columns and settings where neither the request nor an earlier registration has them.
DEFAULTS = {"idColumn": "id", "titleColumn": "title", "contentColumn": "content", "textlenColumn": "textlen", "ftsColumn": "fts", "embeddingColumn": "embedding_qwen", "embeddingHnswColumn": "embedding_hnsw", "embeddingDim": 4096, "embeddingHnswDim": 1024, "reductionMethod": "prefix_truncation"}
NULLABLE = ("docHashColumn", "description")
MISSING = object()


class Refused(ValueError):
    """A request that can't be served; the message is the answer's error."""


def identifier(name) -> str:
    """A name that is safe in SQL as it is."""
    if not isinstance(name, str) or not IDENTIFIER.fullmatch(name):
        raise Refused(f"Unsafe SQL identifier: {name}")
    return name


def quoted(name: str) -> str:
    return f"`{identifier(name)}`"


def literal(value: str) -> str:
    """A string as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(identifier(name))


def text_config(language: str | None, known=LANGUAGES) -> str:
    """The language's analyser, or the plain one where there is none."""
    name = (language or "").strip().lower()
    return name if name in known else "simple"


def scan(spark: SparkSession, name: str) -> DataFrame:
    """A managed table by its checked name."""
    return spark.sql("SELECT * FROM IDENTIFIER(:t)", args={"t": identifier(name)})


# Requests: each parser gives what the request has, or raises with the message of the answer.


def _object(body) -> dict:
    if not isinstance(body, dict):
        raise Refused("Request body must be an object")
    return body


def _text(body: dict, key: str):
    return body[key].strip() if isinstance(body.get(key), str) else MISSING


def _number(body: dict, key: str):
    v = body.get(key)
    if isinstance(v, str) and v.strip():
        try:
            v = float(v)
        except ValueError:
            return MISSING
    return v if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else MISSING


def parse_registration(body) -> dict:
    body = body if isinstance(body, dict) else {}
    out = {k: _text(body, k) for k in ("tableName", "language", "idColumn", "titleColumn", "contentColumn", "textlenColumn", "ftsColumn", "embeddingColumn", "embeddingHnswColumn", "reductionMethod", *NULLABLE)}
    out |= {k: None for k in NULLABLE if k in body and body[k] is None}
    out |= {k: _number(body, k) for k in ("embeddingDim", "embeddingHnswDim")}
    out["makeDefault"] = body["makeDefault"] if isinstance(body.get("makeDefault"), bool) else MISSING
    if not isinstance(out["tableName"], str) or not out["tableName"]:
        raise Refused("tableName must be provided as string")
    return {k: v for k, v in out.items() if v is not MISSING}


def parse_settings(body) -> dict:
    body = _object(body)
    out = {k: v for k in ("k1", "b") if (v := _number(body, k)) is not MISSING}
    if not out:
        raise Refused("At least one of k1 or b must be provided")
    if "k1" in out and out["k1"] <= 0:
        raise Refused("k1 must be greater than 0")
    if "b" in out and not 0 <= out["b"] <= 1:
        raise Refused("b must be between 0 and 1")
    return out


def parse_document(body) -> dict:
    body, out = _object(body), {}
    for key in ("docHash", "title", "content"):
        if key in body:
            if not isinstance(body[key], str) and (key == "content" or body[key] is not None):
                raise Refused(f"{key} must be a string" + ("" if key == "content" else " or null"))
            out[key] = body[key]
    for key in ("embedding", "embeddingHnsw"):
        if key in body:
            v = body[key]
            if v is not None and not (isinstance(v, list) and all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in v)):
                raise Refused(f"{key} must be an array of finite numbers or null")
            out[key] = v
    return out


def parse_id(value) -> int:
    try:
        n = float(value)
    except (TypeError, ValueError):
        n = 0
    if not math.isfinite(n) or n != int(n) or n <= 0:
        raise Refused("id must be a positive integer")
    return int(n)


def parse_chunk(value: str | None) -> int:
    if value is None or not str(value).strip():
        return changes.CHUNK_DEFAULT
    try:
        n = float(value)
    except ValueError:
        n = 0
    if not math.isfinite(n) or n != int(n) or n <= 0:
        raise Refused("chunkSize must be a positive integer")
    return changes.chunk_size(n)


def merged(request: dict, before: dict | None, language: str) -> dict:
    """What the request says, else the earlier registration, else the defaults; a null that is given clears the nullable ones."""
    before = before or {}
    out = {k: request.get(k, before.get(k, v)) for k, v in ({"language": language} | DEFAULTS).items()}
    out |= {k: request[k] if k in request else before.get(k) for k in NULLABLE}
    out["description"] = (out["description"] or "").strip() or None
    out["reductionMethod"] = out["reductionMethod"].strip() or DEFAULTS["reductionMethod"]
    for k in ("embeddingDim", "embeddingHnswDim"):
        out[k] = int(out[k]) if isinstance(out[k], (int, float)) and out[k] >= 1 else DEFAULTS[k]
    return out | {"tableName": request["tableName"], "makeDefault": request.get("makeDefault", before.get("isDefault", request["tableName"] == HOME))}


LOG = "row_id long, task_type int, table_name string, id long, old_len int, old_tokens array<string>, new_len int, new_tokens array<string>"
ROWS = "id long, doc_hash string, title string, content string, fts array<string>, textlen int, embedding array<double>, embedding_hnsw array<double>"
IDLE = {"status": "idle", "total": 0, "processed": 0, "lastId": None, "cancelRequested": False, "lastError": None}


class Admin:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder, Files(spark, folder)
        self._ready = False

    # State

    def bootstrap(self) -> dict:
        """Settings for every language and the catalog, once; what is there stays. A failure is tried again by the next call."""
        if not self._ready:
            state = self.files.read("catalog.json", {"languages": {}, "tables": {}})
            for name in LANGUAGES:
                if name not in state["languages"]:
                    taken = {x["suffix"] for x in state["languages"].values()}
                    state["languages"][name] = {"suffix": unique_suffix(name, taken), "k1": 1.2, "b": 0.75}
            self.files.write("catalog.json", state)
            self._ready = True
        return self.files.read("catalog.json")

    def _save(self, state: dict) -> None:
        self.files.write("catalog.json", state)

    def language(self, name: str) -> dict:
        found = self.bootstrap()["languages"].get((name or "").strip().lower())
        if found is None:
            raise Refused(f"Unsupported text search language: {name}")
        return found

    def table(self, name: str) -> dict:
        found = self.bootstrap()["tables"].get(name)
        if found is None or not found["isActive"]:
            raise Refused(f"Managed table not found: {name}")
        return found

    def tables(self) -> list[dict]:
        return sorted(self.bootstrap()["tables"].values(), key=lambda t: (not t["isDefault"], t["tableName"]))

    def names(self, language: str) -> list[str]:
        return sorted(t["tableName"] for t in self.tables() if t["language"] == language)

    def default_language(self) -> str:
        known = self.bootstrap()["languages"]
        return next((x for x in catalog.LANGUAGE_PRIORITY if x in known), min(known))

    def update_settings(self, language: str, body) -> dict:
        given, state = parse_settings(body), self.bootstrap()
        self.language(language)
        state["languages"][language.strip().lower()] |= given
        self._save(state)
        return self.language(language)

    # Registration

    def register(self, body, source: DataFrame | None = None) -> dict:
        """Registers a table of the session (or source) under its roles; its rows become the corpus's base the first time."""
        request = parse_registration(body)
        name = identifier(request["tableName"])
        state = self.bootstrap()
        before = state["tables"].get(name)
        if source is None and before is None and not table_exists(self.spark, name):
            raise Refused(f"Table does not exist: {name}")
        config = merged(request, before, self.default_language())
        self.language(config["language"])
        for key, column in config.items():
            if key.endswith("Column") and column is not None:
                identifier(column)
        corpus = self.corpus(name)
        if not corpus.versions():
            corpus.write(self._roles(source if source is not None else scan(self.spark, name), config))
        state["tables"][name] = config | {"isActive": True, "isDefault": bool(before and before["isDefault"]), "backfill": (before or {}).get("backfill", dict(IDLE))}
        self._save(state)
        self.refresh(name)
        return self.reconcile(name if config["makeDefault"] else None)[name]

    @staticmethod
    def _roles(df: DataFrame, config: dict) -> DataFrame:
        """The table under the canonical names; a role whose column is missing is null."""
        roles = {"id": "idColumn", "doc_hash": "docHashColumn", "title": "titleColumn", "content": "contentColumn", "fts": "ftsColumn", "textlen": "textlenColumn", "embedding": "embeddingColumn", "embedding_hnsw": "embeddingHnswColumn"}
        kinds = dict(c.split(" ", 1) for c in ROWS.split(", "))
        return df.select(*[(F.col(config[k]) if config[k] in df.columns else F.lit(None)).cast(kinds[r]).alias(r) for r, k in roles.items()])

    def corpus(self, name: str) -> Corpus:
        return Corpus(self.spark, f"{self.folder}/corpus/{identifier(name)}")

    def index(self, language: str) -> Index:
        return Index(self.spark, f"{self.folder}/index/{language}")

    def _log_folder(self, language: str) -> str:
        return f"{self.folder}/log/{language}"

    # Documents

    def _row(self, name: str, i: int):
        return self.corpus(name).read().where(F.col("id") == i).first()

    def _tokens(self, content: str | None) -> tuple[list[str], int]:
        r = self.spark.range(1).select(T.tokens(F.lit(content or "")).alias("t")).select("t", T.text_length(F.col("t")).alias("n")).first()
        return list(r.t), r.n

    def _write(self, name: str, row: dict | None, kind: int, i: int, old) -> dict:
        """The row's new state (None: deleted) as a version, and its task in the log."""
        config, seq = self.table(name), self._next("task")
        rows = self.spark.createDataFrame([[(row or {"id": i}).get(c.split(" ")[0]) for c in ROWS.split(", ")]], ROWS)
        self.corpus(name).write(rows, deleted=row is None)
        task = (seq, kind, name, i, old.textlen if old else None, list(old.fts or []) if old else None, row["textlen"] if row else None, row["fts"] if row else None)
        self.spark.createDataFrame([task], LOG).coalesce(1).write.mode("append").parquet(self._log_folder(config["language"]))
        self.refresh(name)
        return {"tableName": name, "language": config["language"], "id": i, "taskQueued": True, "taskType": ("insert", "update", "delete")[kind]}

    def _next(self, name: str) -> int:
        n = self.files.read(f"sequence-{name}.json", 0) + 1
        self.files.write(f"sequence-{name}.json", n)
        return n

    def _vectors(self, config: dict, given: dict, row: dict) -> None:
        for key, column in (("embedding", "embedding"), ("embeddingHnsw", "embedding_hnsw")):
            if given.get(key) is not None:
                row[column] = V.validate(given[key], config[key + "Dim"], key)
        if "embeddingHnsw" not in given and "embedding" in given:
            row["embedding_hnsw"] = None if given["embedding"] is None else row["embedding"][: config["embeddingHnswDim"]]
        for key, column in (("embedding", "embedding"), ("embeddingHnsw", "embedding_hnsw")):
            if key in given and given[key] is None:
                row[column] = None

    def insert(self, name: str, body) -> dict:
        given, config = parse_document(body), self.table(name)
        if config["docHashColumn"] is not None and not given.get("docHash"):
            raise Refused("docHash is required")
        if "content" not in given:
            raise Refused("content is required")
        if given.get("embedding") is None and given.get("embeddingHnsw") is None:
            raise Refused("embedding or embeddingHnsw is required")
        i = (self.corpus(name).read().agg(F.max("id")).first()[0] or 0) + 1
        fts, n = self._tokens(given["content"])
        row = {"id": i, "doc_hash": given.get("docHash"), "title": given.get("title"), "content": given["content"], "fts": fts, "textlen": n}
        self._vectors(config, given, row)
        return self._write(name, row, 0, i, None)

    def update(self, name: str, i, body) -> dict:
        given, config, i = parse_document(body), self.table(name), parse_id(i)
        if not given:
            raise Refused("At least one field must be provided")
        old = self._row(name, i)
        if old is None:
            raise Refused(f"Document not found: {i}")
        row = old.asDict()
        row |= {c: given[k] for k, c in (("docHash", "doc_hash"), ("title", "title"), ("content", "content")) if k in given}
        if "content" in given:
            row["fts"], row["textlen"] = self._tokens(given["content"])
        self._vectors(config, given, row)
        return self._write(name, row, 1, i, old)

    def delete(self, name: str, i) -> dict:
        self.table(name)
        i = parse_id(i)
        old = self._row(name, i)
        if old is None:
            raise Refused(f"Document not found: {i}")
        return self._write(name, None, 2, i, old)

    # Readiness

    def pending(self, language: str) -> int:
        """Tasks that the index hasn't taken."""
        if not self.files.exists(f"log/{language}"):
            return 0
        log, done = self.spark.read.schema(LOG).parquet(self._log_folder(language)), self.index(language).applied()
        return (log if done is None else log.where(F.col("row_id") > done)).count()

    def refresh(self, name: str) -> dict:
        """Rows, coverages and readiness of a table, from its tables as they are."""
        state = self.bootstrap()
        t = state["tables"][name]
        r = self.corpus(name).read().agg(F.count("*").alias("n"), F.count("embedding_hnsw").alias("e"), F.count_if(F.col("fts").isNotNull() & F.col("textlen").isNotNull()).alias("f")).first()
        at = self.index(t["language"])
        indexed = 0
        if at.versions()[0] >= 0:
            found = at.lengths().where(F.col("table_name") == name).first()
            indexed = found.recordcount if found else 0
        waiting = self.pending(t["language"])
        t |= {"rowCount": r.n, "indexedCount": indexed, "embeddingCoverage": r.e / r.n if r.n else 1.0, "ftsCoverage": r.f / r.n if r.n else 1.0, "bm25Ready": not waiting and (r.n == 0 or indexed == r.n)}
        t["searchEligible"] = t["embeddingCoverage"] >= 1 and t["ftsCoverage"] >= 1 and t["bm25Ready"]
        self._save(state)
        return t

    def reconcile(self, preferred: str | None = None) -> dict:
        """One eligible default: the preferred table, the default so far, the home table, the first by name."""
        state = self.bootstrap()
        ready = [t for t in state["tables"].values() if t["isActive"] and t.get("searchEligible")]
        ready.sort(key=lambda t: (t["tableName"] != preferred, not t["isDefault"], t["tableName"] != HOME, t["tableName"]))
        for t in state["tables"].values():
            t["isDefault"] = bool(ready) and t["tableName"] == ready[0]["tableName"]
        self._save(state)
        return state["tables"]

    # Back-fill

    def _progress(self, name: str, **changed) -> dict:
        state = self.bootstrap()
        state["tables"][name]["backfill"] |= changed
        self._save(state)
        return state["tables"][name]["backfill"]

    def backfill_status(self, name: str) -> dict:
        b = self.table(name)["backfill"]
        return {"tableName": name, **b, "remaining": max(b["total"] - b["processed"], 0)}

    def prepare_backfill(self, name: str) -> dict:
        """Back to the start; the total is the rows that need work, all of them while the table isn't indexed."""
        t = self.refresh(self.table(name)["tableName"])
        rows = self.corpus(name).read()
        n = rows.where(backfill.needs(rows, snapshot=not t["bm25Ready"])).count()
        self._progress(name, **{**IDLE, "total": n})
        return self.backfill_status(name)

    def cancel_backfill(self, name: str) -> dict:
        b = self.table(name)["backfill"]
        self._progress(name, cancelRequested=True, status="cancelled" if b["status"] == "idle" else b["status"])
        return self.backfill_status(name)

    def run_backfill(self, name: str, chunk: int = changes.CHUNK_DEFAULT, emit: Callable[[dict], None] | None = None, cancelled: Callable[[], bool] | None = None) -> dict:
        """Chunks of rows by id from the last one processed: missing columns are filled, and rows that the index lacks are logged against its present state."""
        emit, cancelled, start = emit or (lambda e: None), cancelled or (lambda: False), time.time()
        config, chunk = self.table(name), changes.chunk_size(chunk)
        if not config["backfill"]["total"]:
            self.prepare_backfill(name)
        snapshot = not self.refresh(name)["bm25Ready"]
        b = self._progress(name, status="running", cancelRequested=False, lastError=None)
        tell = lambda event, **more: emit({"event": event, "tableName": name, "chunkSize": chunk, "processedRows": b["processed"], "remainingRows": max(b["total"] - b["processed"], 0), **more})
        tell("started")
        try:
            while True:
                if cancelled() or self.table(name)["backfill"]["cancelRequested"]:
                    b = self._progress(name, status="cancelled", cancelRequested=True)
                    tell("cancelled", elapsedMs=int(1000 * (time.time() - start)))
                    return self.backfill_status(name)
                rows = backfill.chunk(self.corpus(name).read(), b["lastId"], chunk, snapshot).withColumn("legacy", F.lit(None).cast("array<double>"))
                done = backfill.process(rows, config["embeddingDim"], config["embeddingHnswDim"]).drop("legacy").persist()
                ids = sorted(r.id for r in done.select("id").collect())  # a chunk
                if not ids:
                    break
                self.corpus(name).write(done.drop("queued"))
                self._log_missing(name, config["language"], done)
                done.unpersist()
                b = self._progress(name, lastId=ids[-1], processed=min(b["total"], b["processed"] + len(ids)))
                tell("chunk", updatedRows=len(ids), elapsedMs=int(1000 * (time.time() - start)))
        except Exception as e:
            b = self._progress(name, status="error", lastError=str(e).splitlines()[0] if str(e) else type(e).__name__)
            tell("error", message=b["lastError"])
            raise
        b = self._progress(name, status="completed", cancelRequested=False)
        self.refresh(name)
        self.reconcile()
        tell("completed", elapsedMs=int(1000 * (time.time() - start)))
        return self.backfill_status(name)

    def _log_missing(self, name: str, language: str, rows: DataFrame) -> None:
        """Inserts for rows that neither the index nor the log has, so a second run logs nothing twice."""
        have = None
        if self.index(language).versions()[0] >= 0:
            have = self.index(language).tokens(table=name).select("id").distinct()
        if self.files.exists(f"log/{language}"):
            logged = self.spark.read.schema(LOG).parquet(self._log_folder(language)).where(F.col("table_name") == name).select("id").distinct()
            have = logged if have is None else have.unionByName(logged)
        new = rows.select("id", "fts", "textlen") if have is None else rows.select("id", "fts", "textlen").join(have, "id", "left_anti")
        found = new.orderBy("id").collect()  # a chunk
        tasks = [(self._next("task"), 0, name, r.id, None, None, r.textlen, r.fts) for r in found]
        if tasks:
            self.spark.createDataFrame(tasks, LOG).coalesce(1).write.mode("append").parquet(self._log_folder(language))

    # Indexing

    def run_index(self, language: str, chunk: int = changes.CHUNK_DEFAULT, emit: Callable[[dict], None] | None = None, cancelled: Callable[[], bool] | None = None) -> dict:
        """Applies the log's waiting tasks in chunks to the language's index, and refreshes the readiness of its tables."""
        self.language(language)
        at = self.index(language)
        if at.versions()[0] < 0:
            nothing = self.spark.createDataFrame([], "table_name string, id long, tokens array<string>, len int")
            at.build(nothing)
        told = lambda e: emit({"language": language, **e}) if emit else None
        if not self.files.exists(f"log/{language}"):
            last = {"event": "completed", "batches": 0, "tasks": 0}
            told({"event": "started"})
            told(last)
        else:
            last = changes.maintain(self.spark, self._log_folder(language), at.folder, f"{self.folder}/checkpoint/{language}", changes.chunk_size(chunk), told, cancelled)
        for name in self.names(language):
            self.refresh(name)
        self.reconcile()
        return last

    def index_status(self, language: str) -> dict:
        s, at = self.language(language), self.index(language)
        built = at.versions()[0] >= 0
        return {"language": language, **s, "documents": at.lengths().agg(F.coalesce(F.sum("recordcount"), F.lit(0))).first()[0] if built else 0, "tokens": at.frequency().count() if built else 0, "pending": self.pending(language), "tables": self.names(language)}


ROUTES = ("GET languages", "GET tables", "GET bm25/:language/status", "PUT bm25/:language/settings", "GET bm25/:language/run", "POST tables/register-existing", "POST tables/:table/backfill/prepare", "GET tables/:table/backfill/status", "POST tables/:table/backfill/cancel", "GET tables/:table/backfill/run", "POST documents/:table", "PUT documents/:table/:id", "DELETE documents/:table/:id")


def route(admin: Admin, method: str, path: str, body=None, query: dict | None = None) -> dict | Iterator[str]:
    """Serves a request: an envelope, or for runs the events as a stream of text."""
    from .sinks import event_stream

    parts = path.strip("/").split("/")
    try:
        match (method.upper(), *parts):
            case ("GET", "languages"):
                data = admin.bootstrap()["languages"]
            case ("GET", "tables"):
                data = admin.tables()
            case ("GET", "bm25", language, "status"):
                data = admin.index_status(language)
            case ("PUT", "bm25", language, "settings"):
                data = admin.update_settings(language, body)
            case ("GET", "bm25", language, "run"):
                n = parse_chunk((query or {}).get("chunkSize"))
                return event_stream(lambda emit, cancelled: admin.run_index(language, n, emit, cancelled))
            case ("POST", "tables", "register-existing"):
                data = admin.register(body)
            case ("POST", "tables", table, "backfill", "prepare"):
                data = admin.prepare_backfill(table)
            case ("GET", "tables", table, "backfill", "status"):
                data = admin.backfill_status(table)
            case ("POST", "tables", table, "backfill", "cancel"):
                data = admin.cancel_backfill(table)
            case ("GET", "tables", table, "backfill", "run"):
                n = parse_chunk((query or {}).get("chunkSize"))
                return event_stream(lambda emit, cancelled: admin.run_backfill(table, n, emit, cancelled))
            case ("POST", "documents", table):
                data = admin.insert(table, body)
            case ("PUT", "documents", table, i):
                data = admin.update(table, i, body)
            case ("DELETE", "documents", table, i):
                data = admin.delete(table, i)
            case _:
                raise Refused(f"No such route: {method} {path}")
    except ValueError as e:
        return {"success": False, "data": [], "error": str(e)}
    return {"success": True, "data": [data]}
