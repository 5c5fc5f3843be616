"""Quality rules by repetition coverage.

Words are runs of characters other than ASCII white space. Word hashes come from prefix sums over
the bytes of a whole batch, n-gram hashes from prefix sums over the word hashes. For each n-gram
length the characters of words inside n-grams that occurred earlier in the same text are counted
once, and the characters of lines equal to an earlier line likewise. An (n+1)-gram can only repeat
where the n-gram at its start does, so each length looks only at what the shorter one left.

Defined results: a null text counts as empty (no words, so base_failed); a null id is kept;
repeated rows each get a row; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import BASE2, BYTE_VALUE, Batch, Prefix, U, mix
from .runtime import documents, map_texts

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Limits:
    """Most characters in repeated n-grams, by n, and in repeated lines, in hundredths of the characters in words; and the base rules."""

    ngrams: dict = field(default_factory=lambda: {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10})
    lines: int = 20
    least_words: int = 50
    repeat_words: int = 50


def later(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are found twice or more, and which have an equal one before them."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    after = np.zeros(len(key), bool)
    after[order[1:][same]] = True
    twice = after.copy()
    twice[order[:-1][same]] = True
    return twice, after


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in the windows of k words at the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts, lengths=tuple(range(5, 11))) -> dict[str, np.ndarray]:
    """Counts per text; chars_n is by n-gram length, chars_lines the characters of words in repeated lines."""
    b = Batch(texts)
    start, end, first = b.words()
    m, n = len(texts), len(start)
    total = np.zeros(len(b.data) + 1, np.int64)
    np.cumsum((b.data & 0xC0) != 0x80, out=total[1:])
    chars = total[end] - total[start]
    owner = np.repeat(np.arange(m), np.diff(first))
    per_text = lambda values: np.bincount(owner, values, m).astype(np.int64)
    out = {"n_words": np.diff(first), "word_chars": per_text(chars)}
    symbol = np.flatnonzero(SYMBOLS[b.data])
    out["n_symbols"] = np.bincount(np.searchsorted(b.offsets, symbol, "right") - 1, minlength=m)[:m]
    text_key = mix(np.arange(m, dtype=U) + U(1))
    prefix = Prefix(BYTE_VALUE[b.data])
    out |= lines(b, prefix, text_key, start, end, chars, owner, m)
    repeat = np.zeros(n, bool)
    dup = {k: np.zeros(n, bool) for k in lengths}
    if n >= 3:
        seq = Prefix(prefix.ranges(start, end), BASE2)
        at = np.flatnonzero(owner[: n - 2] == owner[2:])
        twice, _ = later(seq.ranges(at, at + 3) ^ text_key[owner[at]])
        at = at[twice]
        repeat = covered(at, 3, n)
        for k in sorted(lengths):
            at = at[at + k <= n]
            at = at[owner[at] == owner[at + k - 1]]
            twice, after = later(seq.ranges(at, at + k) ^ text_key[owner[at]])
            dup[k] = covered(at[after], k, n)
            at = at[twice]
    out["n_repeat_words"] = per_text(repeat)
    return out | {f"chars_{k}": per_text(chars * v) for k, v in dup.items()}


def lines(b: Batch, prefix: Prefix, text_key, start, end, chars, owner, m: int) -> dict[str, np.ndarray]:
    cuts = np.concatenate((np.flatnonzero(b.data == 10), b.offsets[1:] - 1))
    cuts.sort()
    begins = np.concatenate(([0], cuts[:-1] + 1))
    line_of = np.searchsorted(cuts, start)
    has = np.unique(line_of)
    text = np.searchsorted(b.offsets, begins[has], "right") - 1
    _, after = later(prefix.ranges(begins[has], cuts[has]) ^ text_key[text])
    again = np.zeros(len(cuts), bool)
    again[has[after]] = True
    return {"n_dup_lines": np.bincount(text[after], minlength=m), "chars_lines": np.bincount(owner, chars * again[line_of], m).astype(np.int64)}


def repetition(df: DataFrame, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base_failed and kept of every text."""
    limits = limits or Limits()
    lengths = tuple(sorted(limits.ngrams))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[f"chars_{k}" for k in lengths], "chars_lines"]
    counted = map_texts(documents(df, id_col, text_col), lambda rows: {"doc_id": rows["doc_id"]} | measure(rows["text"], lengths), "doc_id long, " + ", ".join(f"{n} long" for n in names))
    failed = (F.col("n_words") < limits.least_words) | (100 * F.col("n_repeat_words") > limits.repeat_words * F.col("n_words"))
    good = 100 * F.col("chars_lines") <= limits.lines * F.col("word_chars")
    for k in lengths:
        good &= 100 * F.col(f"chars_{k}") <= limits.ngrams[k] * F.col("word_chars")
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & good)
