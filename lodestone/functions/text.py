"""Text analysis: tokens, query terms and signals, snippets, tags. Column functions; the query-side ones also as plain Python."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and suffixes that the results depend on.
DOMAIN_ANCHORS = ["포켓몬", "pokemon", "pokémon"]
BROAD_ROOTS = ["대한민국", "한국", "중국", "일본", "미국"]
GENERIC_INTENTS = ["가장", "최고", "좋", "좋은", "추천", "비교", "알려줘", "설명해줘", "정리해줘"]
POSTPOSITIONS = "은 는 이 가 을 를 의 에 에서 으로 로 와 과 에게 한테 께 도 만 부터 까지 처럼 보다 랑".split()
POOL_MOST, POOL_WINDOW = 120, 10
POOL_SHORT, POOL_DEFAULT, POOL_LONG = 12, 9, 6
TERMS_LONG, TERMS_DEFAULT = 3, 4
SIGNALS = 8
EMPTY_SNIPPET = "No summary available."

NOT_WORD = r"[^\p{L}\p{N}\s]"
SUFFIX = f"({'|'.join(POSTPOSITIONS)})$"


def only_words(text: Column) -> Column:
    """Lower-case words of letters and digits, in order, with ASCII white space between."""
    return F.regexp_replace(F.lower(text), NOT_WORD, " ")


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, in order, with repeats."""
    return F.filter(F.split(only_words(text), r"\s+"), lambda t: F.length(t) > 0)


def text_length(tokens_col: Column) -> Column:
    """The length that ranking uses: distinct words."""
    return F.size(F.array_distinct(tokens_col))


def strip_suffix(t: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(t, SUFFIX, ""), F.lit("")), t)


def query_terms(query: Column) -> Column:
    return F.array_distinct(F.transform(tokens(F.trim(query)), strip_suffix))


def words_of(query: str) -> list[str]:
    """A text's tokens, in plain Python."""
    import regex

    return regex.sub(NOT_WORD, " ", query.strip().lower()).split()


def terms_of(query: str) -> list[str]:
    words = words_of(query)
    return list(dict.fromkeys(re.sub(SUFFIX, "", w) or w for w in words))


def units(s: str) -> int:
    """UTF-16 units."""
    return len(s.encode("utf-16-le")) // 2


def utf16_length(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def is_long(terms: list[str], query: str) -> bool:
    return len(terms) >= 4 or units(query.strip().lower()) >= 16


def fixed(x: float, digits: int = 3) -> float:
    """Rounded from the exact binary value, ties up. (SQL rounds the decimal rendering; the two differ at ties of the rendering only.)"""
    return float(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def signals_of(query: str) -> list[tuple[str, float]]:
    """(keyword, weight), highest first, ties in the query's order; the first 8."""
    terms = terms_of(query)
    long = is_long(terms, query)
    out = []
    for i, t in enumerate(terms):
        w = fixed(0.7 * min(units(t) / 8, 1) + 0.3 * max(0.0, 1 - 0.08 * i))
        w *= 1.1 if long and units(t) >= 3 else 1
        w *= 1.35 if t in DOMAIN_ANCHORS else 1
        w *= 0.3 if t.startswith(tuple(BROAD_ROOTS)) else 1
        w *= 0.45 if t in GENERIC_INTENTS else 1
        out.append((t, fixed(w)))
    return sorted(out, key=lambda x: -x[1])[:SIGNALS]


def pool_of(query: str, limit: int, offset: int) -> int:
    terms, n = terms_of(query), units(query.strip().lower())
    times = POOL_SHORT if len(terms) <= 2 and n <= 12 else POOL_LONG if is_long(terms, query) else POOL_DEFAULT
    return min(max(limit + offset, limit, POOL_WINDOW) * times, POOL_MOST)


def bm25_text_of(query: str) -> str:
    most = TERMS_LONG if is_long(terms_of(query), query) else TERMS_DEFAULT
    return " ".join(t for t, _ in signals_of(query)[:most])


def keyword_signal(term: Column, place: Column, long: Column) -> Column:
    """The weight of the term at that place (from 0)."""
    n = utf16_length(term)
    w = F.round(0.7 * F.least(n / 8.0, F.lit(1.0)) + 0.3 * F.greatest(F.lit(0.0), 1 - 0.08 * place), 3)
    broad = F.lit(False)
    for root in BROAD_ROOTS:
        broad = broad | term.startswith(root)
    w = w * F.when(long & (n >= 3), 1.1).otherwise(1.0) * F.when(term.isin(DOMAIN_ANCHORS), 1.35).otherwise(1.0)
    return F.round(w * F.when(broad, 0.3).otherwise(1.0) * F.when(term.isin(GENERIC_INTENTS), 0.45).otherwise(1.0), 3)


#: The rewrites of wiki markup, in their order; each match becomes the second string.
SNIPPET_RULES = [
    (r"\[\[분류:[^\]]+\]\]", " "),
    (r"\[include\([^\]]*\)\]", " "),
    (r"\{\{[^{}]*\}\}", " "),
    (r"\{\{|\}\}", " "),
    (r"\[\[파일:[^\]]+\]\]", " "),
    (r"\[\[https?:[^\]|]+\|([^\]]+)\]\]", "$1"),
    (r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2"),
    (r"\[\[(?:분류|파일):[^\]]*\]\]", " "),
    (r"\[\[([^\]]+)\]\]", "$1"),
    (r"={2,}\s*([^=]+?)\s*={2,}", "$1"),
    (r"\[목차\]", " "),
    (r"<[^>]+>", " "),
    (r"\|\|+", " "),
    (r"\[[^\]]+\]", " "),
    (r"\s+", " "),
]


def snippet_clean(raw: Column) -> Column:
    out = raw
    for pattern, to in SNIPPET_RULES:
        out = F.regexp_replace(out, pattern, to)
    return F.coalesce(F.nullif(F.trim(out), F.lit("")), F.lit(EMPTY_SNIPPET))


def tags(contributors: Column, default: str = "Corpus") -> Column:
    """The first three names; the default where there is none."""
    found = F.slice(F.filter(F.transform(F.split(contributors, ","), lambda t: F.trim(t)), lambda t: F.length(t) > 0), 1, 3)
    return F.when(F.size(F.coalesce(found, F.array().cast("array<string>"))) > 0, found).otherwise(F.array(F.lit(default)))


def matched_keywords(keywords: Column, title: Column, snippet: Column) -> Column:
    target = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), snippet))
    return F.filter(keywords, lambda k: F.contains(target, k))


def keyword_coverage(matched: Column, used: Column) -> Column:
    return F.coalesce(F.round(F.size(matched) / F.nullif(F.size(used), F.lit(0)), 3), F.lit(0.0))


def embed_text(text: Column, most: int = 4000) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)
