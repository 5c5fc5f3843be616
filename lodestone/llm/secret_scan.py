"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean trigram query: strings that every match
must contain become conjunctions of their trigrams, alternatives become disjunctions. Each block
of documents gets an inverted index (trigram -> sorted document numbers) of the trigrams that
some query asks for; the postings are intersected and united as the query says, and only the
documents that remain are searched with the expression. A rule without mandatory trigrams scans
every document. The index lives with its block, so no text crosses the network.

Defined results: a null text counts as empty and has no spans; a null id is kept; repeated rows
each get their spans; an empty table gives an empty one. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import Batch
from .runtime import documents, map_texts


@dataclass(frozen=True)
class Rule:
    """A match counts if it and its group have at least these lengths; its place is that of the group `span`."""

    kind: str
    pattern: str
    ignore_case: bool = False
    least: int = 0
    group: int = 0
    group_least: int = 0
    span: int = 0

    def compiled(self):
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, group=2, group_least=12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}"),  # the runs of [0-9a-f]+ that have 16 characters or more
)
MORE_RULES = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pay", r"[sr]k_live_[A-Za-z0-9]{24,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    # From the first eyJ of a run of its characters: what fails there fails from each later one, so a run is read once.
    Rule("jwt", r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,})", span=1),
)

#: A query: True (no condition), a trigram, or ("and" | "or", frozenset of queries).
ANY = True
#: Strings kept exactly while an expression is walked; beyond that the run is closed.
MOST_STRINGS = 64


def conjunction(parts) -> object:
    flat = set()
    for p in parts:
        if p is not ANY:
            flat |= p[1] if isinstance(p, tuple) and p[0] == "and" else {p}
    return ANY if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def disjunction(parts) -> object:
    flat = set()
    for p in parts:
        if p is ANY:
            return ANY
        flat |= p[1] if isinstance(p, tuple) and p[0] == "or" else {p}
    return next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def of_strings(strings: set[str]) -> object:
    """Any of the strings occurs: trigrams over lower-cased ASCII."""
    if any(len(s) < 3 or not s.isascii() for s in strings):
        return ANY
    return disjunction([conjunction([s.lower()[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def walk(items) -> tuple[set[str] | None, object]:
    """The exact strings that a parsed expression matches (None if too many), and its query."""
    found, exact, whole = [], {""}, True

    def close():
        nonlocal exact, whole
        found.append(of_strings(exact))
        exact, whole = {""}, False

    for op, arg in items:
        strings, query = None, ANY
        if op is C.LITERAL:
            strings = {chr(arg)}
        elif op is C.IN and arg[0][0] is not C.NEGATE and all(o is C.LITERAL or (o is C.RANGE and a[1] - a[0] < 8) for o, a in arg):
            strings = {chr(x) for o, a in arg for x in ([a] if o is C.LITERAL else range(a[0], a[1] + 1))}
            strings = strings if len(strings) <= 8 else None
        elif op is C.SUBPATTERN:
            strings, query = walk(arg[3])
        elif op is C.BRANCH:
            ways = [walk(x) for x in arg[1]]
            strings = set().union(*(w[0] for w in ways)) if all(w[0] is not None for w in ways) else None
            query = disjunction([w[1] for w in ways])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            strings, query = walk(inner)
            if strings is not None and high <= 2:
                strings = {"".join(p) for n in range(low, high + 1) for p in _product(strings, n)}
            else:
                strings = None
                query = query if low else ANY
        elif op is C.AT:
            continue
        if strings is not None and len(exact) * len(strings) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in strings}
        else:
            close()
            if strings is not None and len(strings) <= MOST_STRINGS:
                exact = set(strings)
            else:
                found.append(query)
    query = conjunction([*found, of_strings(exact)])
    return (exact if whole else None), query


def _product(strings: set[str], n: int):
    import itertools

    return itertools.product(strings, repeat=n)


def trigram_query(pattern: str) -> object:
    return walk(_parser.parse(pattern))[1]


def trigrams_of(query) -> set[str]:
    if query is ANY:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1]))


class Index:
    """Postings of the wanted trigrams in a block of texts."""

    def __init__(self, batch: Batch, table: np.ndarray, codes: np.ndarray):
        d = batch.data.astype(np.uint32)
        grams = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:] if len(d) > 2 else np.zeros(0, np.uint32)
        at = np.flatnonzero(table[grams])
        which = np.searchsorted(codes, grams[at])
        text = np.searchsorted(batch.offsets, at, "right") - 1
        pairs = np.unique(which.astype(np.int64) * len(batch.sizes) + text)
        self.n, self.codes = len(batch.sizes), codes
        self.text, self.bounds = pairs % max(self.n, 1), np.searchsorted(pairs, np.arange(len(codes) + 1) * self.n)

    def answer(self, query) -> np.ndarray:
        if query is ANY:
            return np.arange(self.n)
        if isinstance(query, str):
            k = np.searchsorted(self.codes, code_of(query))
            return self.text[self.bounds[k] : self.bounds[k + 1]]
        parts = sorted((self.answer(q) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def code_of(trigram: str) -> int:
    a, b, c = trigram.encode("ascii")
    return a << 16 | b << 8 | c


class Scanner:
    """Rules made ready; kept once in a Python worker."""

    def __init__(self, rules):
        self.rules = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        wanted = sorted({code_of(t) for _, _, q in self.rules for t in trigrams_of(q)})
        self.codes = np.array(wanted, np.uint32)
        self.table = np.zeros(1 << 24, bool)
        self.table[self.codes] = True

    def scan(self, texts) -> list[list[tuple[str, int, int]]]:
        """Per text, its spans by start, then by the order of the rules."""
        found: list[list] = [[] for _ in texts]
        index = Index(Batch(texts, lower=True), self.table, self.codes)
        for k, (rule, compiled, query) in enumerate(self.rules):
            for i in index.answer(query):
                if text := texts[i]:
                    for m in matches(rule, compiled, text):
                        found[i].append((m.start(rule.span), k, m.end(rule.span)))
        return [[(self.rules[k][0].kind, a, b) for a, k, b in sorted(x)] for x in found]


def matches(rule: Rule, compiled, text: str):
    for m in compiled.finditer(text):
        if m.end() - m.start() >= rule.least and (not rule.group or len(m[rule.group]) >= rule.group_least):
            yield m


_scanners: dict = {}


def find_secrets(df: DataFrame, rules=BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end) of every text."""
    rules = tuple(rules)

    def scan(rows):
        if rules not in _scanners:
            _scanners[rules] = Scanner(rules)
        found = _scanners[rules].scan(rows["text"])
        return {"doc_id": rows["doc_id"], "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found]}

    return map_texts(documents(df, id_col, text_col), scan, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def redact(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with each span, or run of overlapping ones, replaced by the mark."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(df: DataFrame, rules=BASE_RULES + MORE_RULES, text_col: str = "text") -> DataFrame:
    """The table with secrets in its texts replaced; every row and other column is kept, and a null text stays null."""
    rules = tuple(rules)
    schema = df.schema
    names = df.columns
    k = names.index(text_col)

    def run(batches):
        import pyarrow as pa

        from .runtime import cut

        if rules not in _scanners:
            _scanners[rules] = Scanner(rules)
        for batch in cut(batches, column=text_col):
            texts = batch.column(k).to_pylist()
            new = [t if not s else redact(t, s) for t, s in zip(texts, _scanners[rules].scan(texts))]
            arrays = [batch.column(i) for i in range(len(names))]
            arrays[k] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


def secret_digest(found: DataFrame) -> DataFrame:
    """The columns of the query, from the spans."""
    base = [r.kind for r in BASE_RULES]
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[n(k).alias(f"n_{k}") for k in base], F.sha2(line(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
