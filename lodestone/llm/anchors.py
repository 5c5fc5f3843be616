"""Anchors of fixed-length windows: a sparse set of text positions that equal windows share.

The anchor of a window of `length` bytes is the position of the smallest hash among its grams of
`gram` bytes, leftmost on ties. It depends on the window's bytes only, so equal windows have equal
grams at the same place within them. Neighbouring windows mostly share their anchor: a run is an
anchor with the range of window starts that have it.
"""

from __future__ import annotations

import numpy as np

from .rolling import BASE2, BYTE_VALUE, BYTE_VALUE2, Batch, Prefix, U


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i : i + w] for each i; blocks of w with minima from both ends."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


class Runs:
    """Runs of a batch: text, first and last window start, anchor (all as places in the buffer); and hashes."""

    def __init__(self, batch: Batch, length: int, gram: int):
        self.length, self.gram = length, gram
        data = batch.data
        self.one = Prefix(BYTE_VALUE[data])
        self._two, self._data = None, data
        g = self.one.windows(gram)
        key = (g & U(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=U)
        anchor = (sliding_min(key, length - gram + 1) & U(0xFFFFFFFF)).astype(np.int64)
        starts = np.arange(len(anchor))
        text = np.repeat(np.arange(len(batch.sizes)), np.diff(batch.offsets))[: len(anchor)]
        ok = starts + length < batch.offsets[1:][text]  # within the text, before the space put after it
        starts, anchor, text = starts[ok], anchor[ok], text[ok]
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        self.text, self.low, self.at = text[at], starts[at], anchor[at]
        self.high = starts[np.append(at[1:], len(starts)) - 1] if len(at) else starts[:0]
        self.begin = batch.offsets[:-1][self.text]

    def pick(self, some: np.ndarray) -> None:
        """Keep only these runs."""
        for name in ("text", "low", "at", "high", "begin"):
            setattr(self, name, getattr(self, name)[some])

    @property
    def two(self) -> Prefix:
        if self._two is None:
            self._two = Prefix(BYTE_VALUE2[self._data], BASE2)
        return self._two

    def gram_hash(self) -> np.ndarray:
        return self.one.ranges(self.at, self.at + self.gram)

    def context(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of all bytes that the run's windows cover."""
        return self.one.ranges(self.low, self.high + self.length), self.two.ranges(self.low, self.high + self.length)
