"""Maps of fixed size over all tasks: count arrays and sets of hashes.

Fixed-size count arrays summed over all tasks: each task sends its non-empty parts compressed, one task a part adds them."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 1 << 16
PARTS = "part int, counts binary"


def pack(counts: np.ndarray) -> bytes:
    """Counts of a part, in bytes where they fit."""
    small = counts.max() < 256
    return zlib.compress((b"\1" + counts.astype(np.uint8).tobytes()) if small else (b"\4" + counts.astype(np.uint32).tobytes()), 1)


def unpack(raw: bytes) -> np.ndarray:
    raw = zlib.decompress(raw)
    return np.frombuffer(raw, np.uint8 if raw[0] == 1 else np.uint32, offset=1)


def packed(counts: np.ndarray) -> pa.RecordBatch | None:
    """The parts of uint32 counts that aren't all 0."""
    rows = [(k, pack(part)) for k in range(-(-len(counts) // PART)) if (part := counts[k * PART : (k + 1) * PART]).any()]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "counts"]) if rows else None


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sums over all tasks; what is collected is the array itself."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, raw in zip(b.column("part").to_pylist(), b.column("counts").to_pylist()):
                counts = unpack(raw)
                have = total.setdefault(part, np.zeros(PART, np.uint64))
                have[: len(counts)] += counts
        for part, counts in total.items():
            raw = pack(np.minimum(counts, 0xFFFFFFFF))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([raw], pa.binary())], names=["part", "counts"])

    out = np.zeros(-(-size // PART) * PART, np.uint32)
    for r in parts.repartition("part").mapInArrow(add, PARTS).collect():
        out[r.part * PART : (r.part + 1) * PART] = unpack(r.counts)
    return out[:size]


#: A map of hashes has some 8 bits a hash, as a power of 2 between these: up to 128 MB are broadcast. Beyond some 130 million
#: hashes it fills up and lets more through that isn't in it; what it lets through is tested by joins, so only they get larger.
LEAST_BITS, MOST_BITS = 20, 30
PART_BYTES = 1 << 15


def bit_of(hashes: np.ndarray, width: int) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - width)).astype(np.int64)


def bitmap(table: DataFrame, column: str) -> np.ndarray:
    """The map of the hashes in a column of longs of a written table: each task makes its own, one task a part unites them."""
    width = min(MOST_BITS, max(LEAST_BITS, (8 * max(1, table.count()) - 1).bit_length()))

    def run(batches):
        own, any_ = np.zeros((1 << width) // 8, np.uint8), False
        for b in batches:
            bit, any_ = bit_of(b.column(0).to_numpy(), width), True
            np.bitwise_or.at(own, bit >> 3, (128 >> (bit & 7)).astype(np.uint8))
        for k in range(len(own) // PART_BYTES if any_ else 0):
            if (part := own[k * PART_BYTES : (k + 1) * PART_BYTES]).any():
                yield row(k, part)

    def row(k, part):
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["part", "bits"])

    def unite(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column("part").to_pylist(), b.column("bits").to_pylist()):
                part = total.setdefault(k, np.zeros(PART_BYTES, np.uint8))
                part |= np.frombuffer(zlib.decompress(raw), np.uint8)
        for k, part in total.items():
            yield row(k, part)

    out = np.zeros((1 << width) // 8, np.uint8)
    for r in table.select(column).mapInArrow(run, "part int, bits binary").repartition("part").mapInArrow(unite, "part int, bits binary").collect():
        out[r.part * PART_BYTES : (r.part + 1) * PART_BYTES] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return out


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the map; one that is always is."""
    bit = bit_of(hashes, (8 * len(bits)).bit_length() - 1)
    return ((bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1).astype(bool)
