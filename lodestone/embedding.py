"""Embedding of queries and documents by providers.

A provider turns texts into vectors. Query vectors come from a worker process that holds a model and
speaks lines of JSON: it says it is ready, then answers requests by id. Models aren't part of this
repository, so the providers here are one that looks stored vectors up and a deterministic one that
hashes words; a worker can be any command.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import queue
import subprocess
import threading
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds a worker has for a request, by model; vectors remembered.
TIMEOUTS = {"qwen3": 180.0, "base": 30.0}
REMEMBERED = 100


class Provider(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class HashingProvider:
    """Words hashed to signed places of a vector of length 1; the same text always gives the same vector."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dim)
            for word in text.lower().split():
                d = hashlib.blake2b(word.encode(), digest_size=8).digest()
                v[int.from_bytes(d[:4], "little") % self.dim] += 1 if d[4] & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


class LookupProvider:
    """Vectors by text, from a bounded mapping."""

    def __init__(self, vectors: dict[str, list[float]]):
        self.vectors = vectors

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [self.vectors[t] for t in texts]


class Worker:
    """A process that answers {"id", "query"} with {"id", "vector"} or {"id", "error"} once it has said {"event": "ready"}."""

    def __init__(self, command: list[str], model: str, timeout: float | None = None):
        self.model, self.timeout = model, timeout if timeout is not None else TIMEOUTS.get(model, TIMEOUTS["base"])
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8")
        self.answers: dict[int, queue.Queue] = {}
        self.is_ready, self.ended, self.lock, self.last = threading.Event(), threading.Event(), threading.Lock(), 0
        threading.Thread(target=self._listen, daemon=True).start()
        if not self._wait_ready():
            self.close()
            raise RuntimeError(f"query-embedding-worker-not-ready:{model}")

    def _wait_ready(self) -> bool:
        waited = 0.0
        while waited < self.timeout and not self.ended.is_set():
            if self.is_ready.wait(0.05):
                return True
            waited += 0.05
        return self.is_ready.is_set()

    def _listen(self) -> None:
        for line in self.process.stdout:
            try:
                said = json.loads(line)
            except ValueError:
                continue  # a model's own chatter
            if said.get("event") == "ready":
                self.is_ready.set()
            elif said.get("id") in self.answers:
                self.answers[said["id"]].put(said)
        self.ended.set()
        for waiting in list(self.answers.values()):
            waiting.put({"error": "query-embedding-worker-ended"})

    def alive(self) -> bool:
        return self.is_ready.is_set() and not self.ended.is_set() and self.process.poll() is None

    def ask(self, query: str) -> list[float]:
        with self.lock:
            self.last += 1
            i, mine = self.last, queue.Queue()
            self.answers[i] = mine
            self.process.stdin.write(json.dumps({"id": i, "query": query}, ensure_ascii=False) + "\n")
            self.process.stdin.flush()
        try:
            said = mine.get(timeout=self.timeout)
        except queue.Empty:
            raise TimeoutError(f"query-embedding-timeout:{self.model}") from None
        finally:
            del self.answers[i]
        if said.get("error") or not said.get("vector"):
            raise RuntimeError(said.get("error") or "query-embedding-vector-missing")
        return said["vector"]

    def close(self) -> None:
        self.process.kill()
        self.process.wait()


class QueryEmbedder:
    """Vectors of queries from one worker a model, which is started again when it has ended; the last hundred are remembered."""

    def __init__(self, command: Callable[[str], list[str]], prewarm: tuple[str, ...] = (), timeout: float | None = None):
        self.command, self.prewarm, self.timeout = command, prewarm, timeout
        self.workers: dict[str, Worker] = {}
        self.remembered: dict[tuple[str, str], list[float]] = {}
        self.lock = threading.Lock()
        for model in prewarm:
            self._worker(model)

    def _worker(self, model: str) -> Worker:
        with self.lock:
            if model not in self.workers or not self.workers[model].alive():
                self.workers[model] = Worker(self.command(model), model, self.timeout)
            return self.workers[model]

    def __call__(self, query: str, model: str = "qwen3") -> list[float] | None:
        query = query.strip()
        if not query:
            return None
        key = (model, query)
        if key not in self.remembered:
            self.remembered[key] = self._worker(model).ask(query)
            if len(self.remembered) > REMEMBERED:
                del self.remembered[next(iter(self.remembered))]
        return self.remembered[key]

    def health(self) -> dict:
        ready = [m for m in self.prewarm if m in self.workers and self.workers[m].alive()]
        pending = [m for m in self.prewarm if m not in ready]
        return {"configuredModels": list(self.prewarm), "readyModels": ready, "pendingModels": pending, "ready": not pending}

    def ready(self) -> bool:
        return self.health()["ready"]

    def close(self) -> None:
        for w in self.workers.values():
            w.close()
        self.workers.clear()


def serve(provider: Provider, lines: Iterator[str], say: Callable[[str], None]) -> None:
    """The worker's side: ready first, then an answer a line."""
    say(json.dumps({"event": "ready"}))
    for line in lines:
        if not line.strip():
            continue
        i = None
        try:
            asked = json.loads(line)
            i = asked["id"]
            say(json.dumps({"id": i, "vector": provider([asked["query"]])[0]}))
        except Exception as e:  # the asker gets it
            say(json.dumps({"id": i, "error": str(e) or type(e).__name__}))


def device(cuda: bool, mps: bool, bf16: bool = False) -> tuple[str, str]:
    """Where a model runs and in which numbers: cuda before mps before cpu; 16 bits on a device, bfloat where it has them."""
    if cuda:
        return "cuda", "bfloat16" if bf16 else "float16"
    return ("mps", "float16") if mps else ("cpu", "float32")


def embed_documents(df: DataFrame, provider: Provider, dim: int, text_col: str = "text", to: str = "embedding", size: int = 32) -> DataFrame:
    """The table with a column of vectors, made in Arrow batches on the executors; null and empty texts have none. Wrong sizes and numbers that aren't finite are an error."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            asked = [k for k, t in enumerate(texts) if t]
            vectors = [v for lo in range(0, len(asked), size) for v in provider([texts.iloc[k] for k in asked[lo : lo + size]])]
            out: list = [None] * len(texts)
            for k, v in zip(asked, vectors):
                if len(v) != dim or not all(map(math.isfinite, v)):
                    raise ValueError(f"a vector of {dim} finite numbers is needed")
                out[k] = [float(x) for x in v]
            yield pd.Series(out, dtype=object)

    return df.withColumn(to, embed(F.col(text_col)))
