"""A byte-level BPE vocabulary with word ends, read from a tokenizer file, and the exact path from a text to ids.

The path is the file's own: added tokens are cut out of the raw text; the rest is NFC, white space
made single, lower case by character; pieces are contractions, runs of letters, single numbers and
runs of anything else; the bytes of a piece, the last one marked as a word's end, are merged by rank.
A file with other steps than these is an error, as its ids would silently be wrong.
White space separates pieces and no step reaches across ASCII white space, so the ids of a text are
those of its words, one after the other.
"""

from __future__ import annotations

import json
import os
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import regex

PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

#: Kinds of bytes: 1 an ASCII letter, 2 a digit, 3 another mark but the apostrophe, 0 the rest; and between which kinds a piece ends.
KIND = np.array([1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 if 32 < b < 127 and b != 39 else 0 for b in range(128)] + [0] * 128, np.uint8)
ENDS = np.array([a and b and (a != b or a == 2) for a in range(4) for b in range(4)], bool)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

#: The steps of a tokenizer file that this module follows, and the settings of its model and added tokens.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def check_steps(spec: dict, path: str) -> None:
    """Raises where a file's steps aren't those of this module."""
    wrong = [k for k, v in STEPS.items() if spec.get(k) != v] + [f"model.{k}" for k, v in MODEL.items() if spec["model"].get(k, v) != v]
    if not spec["model"].get("end_of_word_suffix"):
        wrong.append("model.end_of_word_suffix")
    wrong += [f"added token {t['content']}" for t in spec["added_tokens"] if any(t.get(k, v) != v for k, v in ADDED.items()) or regex.search(r"\s", t["content"]) or not t["content"]]
    if wrong:
        raise ValueError(f"{path}: unsupported steps: {', '.join(wrong)}")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next one from 256 up."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


BYTE_CHARS = byte_alphabet()
BYTE_OF = {c: b for b, c in enumerate(BYTE_CHARS)}


#: Bits of an id within a pair.
PAIR = 22
NO_PAIR = 1 << 62
#: Bytes of a piece beyond which a heap finds the next pair.
LONG = 96


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_steps(spec, path)
        model = spec["model"]
        self.path, self._library = path, None
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        if len(self.ids) >= 1 << PAIR or any(x not in self.ids for a, b in merges for x in (a, b, a + b)):
            raise ValueError(f"{path}: merges name tokens that the vocabulary lacks, or it has {1 << PAIR} tokens or more")
        #: For two ids, as one number: the rank of their merge and the id it makes, as one number.
        self.pairs = {self.ids[a] << PAIR | self.ids[b]: k << PAIR | self.ids[a + b] for k, (a, b) in reversed(list(enumerate(merges)))}
        #: The id of each byte, within a piece and at its end; one below 0 where the vocabulary has none.
        self.byte_ids, self.last_ids = ([self.ids.get(c + end, -1 - b) for b, c in enumerate(BYTE_CHARS)] for end in ("", self.end))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {k: t for t, k in self.ids.items()} | {k: t for t, k in self.added.items()}
        self.size = max(self.tokens) + 1
        self._hint = os.path.commonprefix(list(self.added))  # in every added token, so most texts need no search
        self._special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None

    def has_added(self, text: str) -> bool:
        return self._special is not None and self._hint in text and self._special.search(text) is not None

    def parts(self, text: str):
        """(is it an added token, string) in order: added tokens and normalised pieces."""
        at = 0
        for m in self._special.finditer(text) if self.has_added(text) else ():
            yield from ((False, p) for p in self.split(text[at : m.start()]))
            yield True, m[0]
            at = m.end()
        yield from ((False, p) for p in self.split(text[at:] if at else text))

    def words(self, texts) -> list[list[bytes]]:
        """Each text cut at ASCII white space and wherever a piece certainly ends, lower case where that is certain, so that far fewer words differ.

        A piece ends between ASCII letters, digits and other marks, and between digits; not at an apostrophe, which may begin
        a contraction. A letter that a character beyond ASCII follows keeps its case, as the two may be composed first.
        """
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        whole = b" ".join(raw)
        if not whole or self._special is not None and self._hint.encode() in whole:
            return [r.split() for r in raw]
        data = np.frombuffer(whole, np.uint8)
        kind = KIND[data]
        cut = np.flatnonzero(ENDS[kind[:-1] * 4 + kind[1:]]) + 1
        low = LOWER[data]
        held = np.flatnonzero(data[1:] >= 128)  # the character before one beyond ASCII
        low[held] = data[held]
        size = np.cumsum([len(r) + 1 for r in raw])
        size += np.searchsorted(cut, size)
        flat = np.insert(low, cut, 32).tobytes()
        return [flat[a:b].split() for a, b in zip([0, *size.tolist()], size.tolist())]

    def normalised(self, words: list[bytes]) -> list[str]:
        """Each word normalised, all in one go; empty for words that need more than that (added tokens, characters new to Unicode), which `parts` splits."""
        text = b" ".join(words).decode("utf-8", "surrogatepass")
        plain = text.isascii() or text.isprintable()
        if plain and not self.has_added(text):
            return lowered(text).split(" ")
        return [lowered(t) if (t.isascii() or t.isprintable()) and not self.has_added(t) else "" for t in text.split(" ")]

    def split(self, text: str) -> list[str]:
        """Normalised pieces. Characters that this Python's Unicode tables don't have yet are left to the library's own steps."""
        if text.isascii() or text.isprintable() or not any(unicodedata.category(c) == "Cn" for c in text):
            return pieces(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        steps = self._library
        found = steps.pre_tokenizer.pre_tokenize_str(steps.normalizer.normalize_str(text))
        return [bytes(BYTE_OF[c] for c in p).decode("utf-8", "surrogatepass") for p, _ in found]

    def merge(self, piece: str) -> list[int]:
        """The ids of one normalised piece: always the pair of lowest rank, leftmost first. Only the pairs beside a merge are looked up again."""
        raw = piece.encode("utf-8", "surrogatepass")
        ids = [self.byte_ids[b] for b in raw]
        ids[-1] = self.last_ids[raw[-1]]
        if len(ids) > LONG:
            return self.merge_long(ids)
        find = self.pairs.get
        found = [find(a << PAIR | b, NO_PAIR) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) != NO_PAIR:
            k = found.index(best)
            ids[k] = best & (1 << PAIR) - 1
            del ids[k + 1], found[k]
            if k:
                found[k - 1] = find(ids[k - 1] << PAIR | ids[k], NO_PAIR)
            if k < len(found):
                found[k] = find(ids[k] << PAIR | ids[k + 1], NO_PAIR)
        return [k for k in ids if k >= 0]

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of (rank and result, place) over a linked list: n log n for a piece of n bytes. An entry counts if its pair is still the one at its place."""
        find, n = self.pairs.get, len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
        found = [find(a << PAIR | b, NO_PAIR) for a, b in zip(ids, ids[1:])] + [NO_PAIR]
        heap = [(x, k) for k, x in enumerate(found) if x != NO_PAIR]
        heapify(heap)
        while heap:
            best, k = heappop(heap)
            if not alive[k] or found[k] != best:
                continue
            gone = after[k]
            ids[k], alive[gone], after[k] = best & (1 << PAIR) - 1, 0, after[gone]
            if after[k] < n:
                before[after[k]] = k
            for at in (before[k], k):
                if at >= 0:
                    found[at] = find(ids[at] << PAIR | ids[after[at]], NO_PAIR) if after[at] < n else NO_PAIR
                    if found[at] != NO_PAIR:
                        heappush(heap, (found[at], at))
        return [k for k, a in zip(ids, alive) if a and k >= 0]


def lowered(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() alone would make a final sigma
    return text.lower()


def pieces(text: str) -> list[str]:
    text = lowered(text)
    if text.isalpha():  # the usual words: letters, or letters and one more character
        return [text]
    if text[-1:] in (".", ",") and text[:-1].isalpha():
        return [text[:-1], text[-1]]
    return PIECES.findall(text)
