"""Vectorised word splitting and rolling hashes over batches of UTF-8 texts.

Texts of a batch are laid end to end in one byte buffer, with one space after each, so
numpy works on the whole batch at once. Hashes are polynomials modulo 2**64 over random
per-byte values, finished by a mixing step; prefix sums make the hash of any byte range a
subtraction and a multiplication.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240611)
BASE = U(0x9E3779B97F4A7C15)
BASE2 = U(0xD1342543DE82EF95)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BYTE_VALUE2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, np.ndarray] = {}


def inverse(x: int) -> int:
    return pow(int(x), -1, 1 << 64)


def powers(base: U, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and doubled on demand."""
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.ones(size, U)
        out[1] = base
        done = 2
        while done < size:  # doubling: the second half is the first times base**done
            out[done : 2 * done] = out[:done] * U(pow(key, done, 1 << 64))
            done *= 2
        _powers[key] = have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


class Prefix:
    """Hashes of byte ranges of one buffer: sum of value(byte) * base**(-position from the start of the range)."""

    def __init__(self, values: np.ndarray, base: U = BASE):
        n = len(values)
        self.p = powers(base, n + 1)
        self.inv = powers(U(inverse(base)), n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * self.p[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(U))

    def windows(self, k: int) -> np.ndarray:
        """Hash of the window of length k at each start."""
        m = len(self.sums) - k
        if m <= 0:
            return np.zeros(0, U)
        return mix((self.sums[k:] - self.sums[:-k]) * self.inv[:m])


class Batch:
    """Texts (str, bytes or None) as one buffer; offsets[i]:offsets[i+1]-1 is text i without the space put after it."""

    def __init__(self, texts, lower: bool = False):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else bytes(t) for t in texts]
        self.sizes = np.fromiter((len(r) for r in raw), np.int64, len(raw))
        self.offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(self.sizes + 1, out=self.offsets[1:])
        raw.append(b"")
        self.data = np.frombuffer(b" ".join(raw), np.uint8)
        if lower:
            self.data = LOWER[self.data]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word (a run of bytes that aren't ASCII white space), and the first word of each text (one more at the end)."""
        space = IS_SPACE[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
        start, end = edge[0::2], edge[1::2]
        return start, end, np.searchsorted(start, self.offsets)


def window_sums(values: np.ndarray, k: int) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[k:] - total[:-k]


def shingles(batch: Batch, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct k-word shingles of each text, sorted within it, and the bounds of each text's.

    A text with 1 to k-1 words has its whole sequence as one shingle; one without words has none.
    """
    start, end, first = batch.words()
    n_words = np.diff(first)
    word = Prefix(BYTE_VALUE[batch.data]).ranges(start, end) if len(start) else np.zeros(0, U)
    text = np.repeat(np.arange(len(n_words)), n_words)
    seq = Prefix(word, BASE2) if len(word) else None
    parts, owner = [], []
    if seq is not None:
        if len(word) >= k:
            h = seq.windows(k)
            ok = text[: len(h)] == text[k - 1 :]
            parts.append(h[ok])
            owner.append(text[: len(h)][ok])
        short = np.flatnonzero((n_words > 0) & (n_words < k))
        if len(short):
            parts.append(seq.ranges(first[short], first[short + 1]))
            owner.append(short)
    if not parts:
        return np.zeros(0, U), np.zeros(len(n_words) + 1, np.int64)
    h, o = np.concatenate(parts), np.concatenate(owner)
    if len(parts) > 1:
        order = np.argsort(o, kind="stable")
        h, o = h[order], o[order]
    bounds = np.searchsorted(o, np.arange(len(n_words) + 1))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        h[lo:hi].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[keep], o[keep]
    return h, np.searchsorted(o, np.arange(len(n_words) + 1))


def slices(texts, most_bytes: int = 1 << 21):
    """Index ranges of texts with at most that many bytes each, or one text."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = 0 if t is None else len(t)
        if i > lo and size + n > most_bytes:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)
