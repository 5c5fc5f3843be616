"""Document vectors that are learned: a randomised singular value decomposition of the weighted term matrix.

Terms are the most frequent ones (TERMS at most, by documents), weighted by (1 + ln tf) * idf, rows of unit length. The matrix is written once as
sparse rows. Subspace iteration finds its leading right singular vectors: each pass multiplies the rows of a task with the
basis and back, only the sums by term (TERMS times the basis' width, a fixed size) are added up and orthonormalised by QR. A document's vector is
its row times those vectors; a query's is made in the same way, so both can be compared.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.analysers import cut

TERMS, DIM, MORE, PASSES = 1 << 14, 64, 16, 3
#: Entries of sparse rows that are multiplied at once: each is a row of the basis' width there.
ENTRIES = 1 << 15
#: Terms of a part of the sums.
PART = 1 << 10
ROW = "id long, codes array<int>, weights array<float>"


def products(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """codes, weights and row of the entries of sparse rows."""
    sizes = pc.list_value_length(batch.column("codes")).to_numpy(zero_copy_only=False).astype(np.int64)
    codes, weights = (pc.list_flatten(batch.column(c)).to_numpy(zero_copy_only=False) for c in ("codes", "weights"))
    return codes, weights, np.repeat(np.arange(len(sizes)), sizes), len(sizes)


def times(codes, weights, row, n: int, basis: np.ndarray) -> np.ndarray:
    """Sparse rows times the basis."""
    out = np.zeros((n, basis.shape[1]))
    if len(codes):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[first]] = np.add.reduceat(basis[codes] * weights[:, None], first, axis=0)
    return out


class Latent:
    """folder/terms: code, token, idf; folder/rows: the sparse rows; folder/model: code, v (the term's share of a vector)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._model: tuple | None = None

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(ROW).parquet(f"{self.folder}/rows")

    def fit(self, docs: DataFrame, dim: int = DIM, seed: int = 3) -> Latent:
        """docs: id, tokens."""
        n = docs.count()
        df = docs.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
        chosen = sorted(((r.token, r.df) for r in df.orderBy(F.desc("df"), "token").limit(TERMS).collect()))  # TERMS rows
        code, idf = {t: k for k, (t, _) in enumerate(chosen)}, np.array([math.log((1 + n) / (1 + d)) + 1 for _, d in chosen])
        sent = self.spark.sparkContext.broadcast((code, idf))

        def sparse(batches):
            for b in cut(batches):
                codes, weights = [], []
                for tokens in b.column("tokens").to_pylist():
                    own = row_of(tokens or (), *sent.value)
                    codes.append(own[0])
                    weights.append(own[1])
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(codes, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float32()))], names=["id", "codes", "weights"])

        docs.select(F.col("id").cast("long").alias("id"), "tokens").mapInArrow(sparse, ROW).write.mode("overwrite").parquet(f"{self.folder}/rows")
        v = len(chosen)
        width = min(dim + MORE, max(1, v))
        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(v, width)))[0] if v else np.zeros((0, width))
        for _ in range(PASSES):
            basis = np.linalg.qr(self._back(basis))[0] if v else basis
        gram = self._gram(basis)
        values, vectors = np.linalg.eigh(gram)
        model = basis @ vectors[:, np.argsort(-values)[:dim]]
        rows = [(k, t, float(idf[k]), model[k].tolist()) for k, (t, _) in enumerate(chosen)]
        self.spark.createDataFrame(rows, "code int, token string, idf double, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/model")
        self._model = None
        return self

    def _back(self, basis: np.ndarray) -> np.ndarray:
        """The matrix, transposed, times the matrix times the basis: sums by term over all tasks."""
        sent, width = self.spark.sparkContext.broadcast(basis), basis.shape[1]

        def run(batches):
            total = np.zeros_like(sent.value)
            for b in cut(batches, "codes", ENTRIES):
                codes, weights, row, n = products(b)
                y = times(codes, weights, row, n, sent.value)
                order = np.argsort(codes, kind="stable")
                c = codes[order]
                first = np.flatnonzero(np.diff(c, prepend=-1))
                if len(first):
                    total[c[first]] += np.add.reduceat(y[row[order]] * weights[order][:, None], first, axis=0)
            yield parts(total)

        def parts(total):
            own = [(k, total[k : k + PART].tobytes()) for k in range(0, len(total), PART)]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int32()), pa.array([x for _, x in own], pa.binary())], names=["part", "sums"])

        def add(batches):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for k, raw in zip(b.column("part").to_pylist(), b.column("sums").to_pylist()):
                    total[k] = total.get(k, 0) + np.frombuffer(raw)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "sums"])

        kind = "part int, sums binary"
        out = np.zeros_like(basis)
        for r in self.rows.mapInArrow(run, kind).repartition("part").mapInArrow(add, kind).collect():  # TERMS x width numbers
            out[r.part : r.part + PART] = np.frombuffer(r.sums).reshape(-1, width)
        return out

    def _gram(self, basis: np.ndarray) -> np.ndarray:
        sent, width = self.spark.sparkContext.broadcast(basis), basis.shape[1]

        def run(batches):
            total = np.zeros((width, width))
            for b in cut(batches, "codes", ENTRIES):
                y = times(*products(b), sent.value)
                total += y.T @ y
            yield pa.RecordBatch.from_arrays([pa.array([k for k in range(width)], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["k", "s"])

        out = np.zeros((width, width))
        sums = self.rows.mapInArrow(run, "k int, s array<double>").groupBy("k").agg(*[F.sum(F.get("s", F.lit(j))) for j in range(width)])
        for r in sums.collect():
            out[r[0]] = r[1:]
        return out

    def model(self) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        if self._model is None:
            rows = sorted(self.spark.read.parquet(f"{self.folder}/model").collect(), key=lambda r: r.code)
            self._model = {r.token: r.code for r in rows}, np.array([r.idf for r in rows]), np.array([r.v for r in rows]).reshape(len(rows), -1) if rows else np.zeros((0, 1))
        return self._model

    def vectors(self) -> DataFrame:
        """id, embedding of all fitted documents, of unit length; null where no term is known."""
        sent = self.spark.sparkContext.broadcast(self.model()[2])

        def run(batches):
            for b in cut(batches, "codes", ENTRIES):
                y = times(*products(b), sent.value)
                norm = np.linalg.norm(y, axis=1)
                unit = y / np.maximum(norm, 1e-12)[:, None]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([u.tolist() if s > 1e-12 else None for u, s in zip(unit, norm)], pa.list_(pa.float32()))], names=["id", "embedding"])

        return self.rows.mapInArrow(run, "id long, embedding array<float>")

    def embed(self, text: str) -> list[float] | None:
        """A query's vector, for the engine."""
        code, idf, v = self.model()
        codes, weights = row_of(T.words_of(text), code, idf)
        y = np.array(weights) @ v[codes] if codes else np.zeros(1)
        norm = np.linalg.norm(y)
        return (y / norm).tolist() if norm > 1e-12 else None


def row_of(tokens, code: dict[str, int], idf: np.ndarray) -> tuple[list[int], list[float]]:
    """A document's row: its terms by code, and their weights."""
    tf = Counter(code[t] for t in tokens if t in code)
    codes = sorted(tf)
    w = np.array([(1 + math.log(tf[k])) * idf[k] for k in codes])
    return codes, (w / np.linalg.norm(w)).tolist() if len(w) else []
