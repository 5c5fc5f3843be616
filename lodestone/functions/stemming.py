"""English stems by the published Porter2 algorithm, with stop words, and positions kept."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# The algorithm's endings, exceptions and the usual stop words.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
SPECIAL_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": ""}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
STOP_WORDS = frozenset("i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split())


def after(word: str, start: int) -> int:
    """Where the region begins: behind the first letter that isn't a vowel after a vowel."""
    m = re.compile("[aeiouy][^aeiouy]").search(word, start)
    return m.end() if m else len(word)


def short_end(word: str) -> bool:
    """The word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(1 << 17)
def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii():
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = word.removeprefix("'")
    word = re.sub("(^|[aeiouy])y", r"\1Y", word)
    start = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = start if start is not None else after(word, 0)
    r2 = after(word, r1)

    if end := longest(word, ("'", "'s", "'s'")):
        word = word[: -len(end)]

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in SPECIAL_AFTER_1A:
        return word

    end = longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and any(c in VOWELS for c in word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and short_end(word):
            word += "e"

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    end = longest(word, STEP_2)
    if end and len(word) - len(end) >= r1:
        before = word[: -len(end)]
        if end == "li":
            word = before if before[-1:] in tuple("cdeghkmnrt") else word
        elif end == "ogi":
            word = before + "og" if before.endswith("l") else word
        else:
            word = before + STEP_2[end]

    end = longest(word, STEP_3)
    if end and len(word) - len(end) >= r1 and (end != "ative" or len(word) - len(end) >= r2):
        word = word[: -len(end)] + STEP_3[end]

    end = longest(word, STEP_4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]

    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not short_end(word[:-1])):
        word = word[:-1]
    elif word.endswith("l") and len(word) - 1 >= r2 and word[-2:-1] == "l":
        word = word[:-1]
    return word.lower()


def stems(df: DataFrame, tokens: Column, id_col: str = "id") -> DataFrame:
    """id, stem, positions (from 1, over all tokens), tf of each document's words that aren't stop words. All of a document's words are in its row, so nothing is shuffled."""

    from .analysers import cut, english, placed_rows

    def run(batches):
        terms = english()
        for b in cut(batches):
            yield from placed_rows(b, terms, "stem")

    return df.select(F.col(id_col).cast("long").alias("id"), tokens.alias("tokens")).mapInArrow(run, "id long, stem string, positions array<int>, tf long")


def query_stems(query: str) -> list[str]:
    """A query's stems in order, each once."""
    return list(dict.fromkeys(stem(w) for w in T.words_of(query) if w not in STOP_WORDS))
