"""Media columns: signature sniffing, validation, correction of declared types and carving.

One Aho-Corasick automaton finds the magic bytes of all formats in one pass over a value. At each
hit the format's validator walks the structure (chunks, checksums, declared lengths) and gives the
length of the medium, or rejects the hit. A medium that starts at byte 0 gives the value's true
type, whatever was declared; each further valid hit is embedded media and can be carved out.

Text payloads are stored as 8-bit unsigned mono PCM in a WAVE container, one sample a byte.

Defined results: a null value counts as empty and has no media, its declared type stands; repeated
rows each get a row; a truncated or corrupt medium is not reported; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, documents

#: Magic bytes and the format whose validator looks at them.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "png",
    b"\xff\xd8\xff": "jpeg",
    b"GIF87a": "gif",
    b"GIF89a": "gif",
    b"RIFF": "riff",
    b"BM": "bmp",
    b"OggS": "ogg",
    b"%PDF-": "pdf",
    b"PK\x03\x04": "zip",
    b"\x1f\x8b\x08": "gzip",
}
#: Media types by format; of RIFF by its form.
TYPES = {"png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "ogg": "audio/ogg", "pdf": "application/pdf", "zip": "application/zip", "gzip": "application/gzip"}
FORMS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}


class Marks:
    """What the validators of one value look for again and again, found once, so many false starts cost no new search each."""

    def __init__(self, d: bytes):
        self.d, self.places, self.jpeg, self.archives = d, {}, (0, -1), None
        self.chains: dict[int, int] = {}
        self.gifs: dict[int, tuple[int | None, bool]] = {}

    def of(self, mark: bytes) -> list[int]:
        """All places of a mark, in order."""
        if mark not in self.places:
            out, at = [], self.d.find(mark)
            while at >= 0:
                out.append(at)
                at = self.d.find(mark, at + 1)
            self.places[mark] = out
        return self.places[mark]

    def jpeg_marker(self, pos: int) -> int:
        """The first marker from pos on that is neither stuffing, a restart nor a fill byte; -1 if there is none."""
        low, found = self.jpeg
        if not low <= pos <= found:
            m = JPEG_MARKER.search(self.d, pos)
            found = m.start() if m else len(self.d)
            self.jpeg = (pos, found)
        return found if found < len(self.d) else -1

    def chain_end(self, pos: int) -> int:
        """Where the sub-blocks from pos on end, beyond the value if they don't; no place is followed twice."""
        d, went = self.d, []
        while pos < len(d) and pos not in self.chains and d[pos]:
            went.append(pos)
            pos += d[pos] + 1
        end = self.chains.get(pos, pos + 1) if pos < len(d) else len(d) + 1
        self.chains.update(dict.fromkeys(went, end))
        return end

    def gif_end(self, pos: int, table) -> tuple[int | None, bool]:
        """The end of the GIF whose next block is at pos (None if there is none), and whether a frame comes before it; no place is followed twice."""
        d, went, known = self.d, [], (None, False)
        while pos < len(d):
            if pos in self.gifs:
                known = self.gifs[pos]
                break
            if d[pos] == 0x3B:
                known = (pos + 1, False)
                break
            frame = d[pos] == 0x2C and pos + 10 <= len(d)
            if not frame and d[pos] != 0x21:
                break
            went.append((pos, frame))
            pos = self.chain_end(pos + 10 + table(d[pos + 9]) + 1 if frame else pos + 2)
        for at, frame in reversed(went):
            known = (known[0], known[1] or frame)
            self.gifs[at] = known
        return known

    def zip_end(self, at: int) -> int | None:
        """The end of the first archive that starts there by its end record."""
        if self.archives is None:
            self.archives = {}
            for end in self.of(b"PK\x05\x06"):
                if end + 22 <= len(self.d):
                    size, offset, note = struct.unpack_from("<IIH", self.d, end + 12)
                    if end + 22 + note <= len(self.d):
                        self.archives.setdefault(end - size - offset, end + 22 + note)
        return self.archives.get(at)


JPEG_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)


def png(d: bytes, at: int, marks: Marks):
    pos = at + 8
    first = True
    while pos + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, pos)
        if pos + 12 + n > len(d) or (first and (kind != b"IHDR" or n != 13)) or zlib.crc32(memoryview(d)[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", d, pos + 8 + n)[0]:
            return None
        pos, first = pos + 12 + n, False
        if kind == b"IEND":
            return "image/png", pos - at
    return None


def jpeg(d: bytes, at: int, marks: Marks):
    pos = at + 2
    while pos + 4 <= len(d) and d[pos] == 0xFF:
        kind, n = d[pos + 1], struct.unpack_from(">H", d, pos + 2)[0]
        if kind < 0xC0 or n < 2:
            return None
        pos += 2 + n
        if kind == 0xDA:  # entropy-coded data
            if (pos := marks.jpeg_marker(pos)) < 0:
                return None
            if d[pos + 1] == 0xD9:
                return "image/jpeg", pos + 2 - at
    return None


def gif(d: bytes, at: int, marks: Marks):
    if at + 13 > len(d):
        return None
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    end, framed = marks.gif_end(at + 13 + table(d[at + 10]), table)
    return ("image/gif", end - at) if end is not None and framed else None


def riff(d: bytes, at: int, marks: Marks):
    if at + 12 > len(d):
        return None
    n, form = struct.unpack_from("<I4s", d, at + 4)
    end, pos, kinds = at + 8 + n, at + 12, []
    if form not in FORMS or end > len(d) or n < 4:
        return None
    while pos + 8 <= end:
        kind, size = struct.unpack_from("<4sI", d, pos)
        kinds.append(kind)
        pos += 8 + size + (size & 1)
    if pos not in (end, end + 1) or not kinds or (form == b"WAVE" and not (kinds[0] == b"fmt " and b"data" in kinds)):
        return None
    return FORMS[form], end - at


def bmp(d: bytes, at: int, marks: Marks):
    if at + 18 > len(d):
        return None
    n, reserved, offset, header = struct.unpack_from("<IIII", d, at + 2)
    ok = reserved == 0 and header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= offset <= n and at + n <= len(d)
    return ("image/bmp", n) if ok else None


REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def ogg_crc(page: bytes) -> int:
    """The page checksum (polynomial 0x04C11DB7, no reflection): zlib's with the bits of each byte, and of the result, reversed."""
    return int(f"{zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def ogg(d: bytes, at: int, marks: Marks):
    pos, serial = at, None
    while pos + 27 <= len(d) and d[pos : pos + 4] == b"OggS" and d[pos + 4] == 0:
        flags, own, n = d[pos + 5], d[pos + 14 : pos + 18], d[pos + 26]
        end = pos + 27 + n + sum(d[pos + 27 : pos + 27 + n])
        if serial is None and not flags & 2 or serial not in (None, own) or end > len(d):
            return None
        if ogg_crc(d[pos : pos + 22] + bytes(4) + d[pos + 26 : end]) != struct.unpack_from("<I", d, pos + 22)[0]:
            return None
        serial, pos = own, end
        if flags & 4:
            return "audio/ogg", pos - at
    return None


def pdf(d: bytes, at: int, marks: Marks):
    """Up to the last end mark before the next header; a place of the cross-reference table comes before it."""
    heads, ends, tables = marks.of(b"%PDF-"), marks.of(b"%%EOF"), marks.of(b"startxref")
    k = bisect_right(heads, at)
    stop = bisect_right(ends, (heads[k] if k < len(heads) else len(d)) - 5)
    if not stop or ends[stop - 1] < at:
        return None
    end, j = ends[stop - 1], bisect_left(tables, at)
    return ("application/pdf", end + 5 - at) if j < len(tables) and tables[j] + 9 <= end else None


def zipped(d: bytes, at: int, marks: Marks):
    end = marks.zip_end(at)
    return None if end is None else ("application/zip", end - at)


def gzipped(d: bytes, at: int, marks: Marks):
    stream, rest, view = zlib.decompressobj(31), at, memoryview(d)
    try:
        while not stream.eof and rest < len(d):  # bounded output at a time, which is thrown away
            stream.decompress(stream.unconsumed_tail or view[rest : rest + 65536], 1 << 16)
            if not stream.unconsumed_tail and not stream.eof:
                rest += 65536
    except zlib.error:
        return None
    return ("application/gzip", min(rest + 65536, len(d)) - len(stream.unused_data) - at) if stream.eof else None


VALIDATORS = {"png": png, "jpeg": jpeg, "gif": gif, "riff": riff, "bmp": bmp, "ogg": ogg, "pdf": pdf, "zip": zipped, "gzip": gzipped}

_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for magic, kind in MAGIC.items():
            _automaton.add_word(magic.decode("latin-1"), (len(magic), kind))
        _automaton.make_automaton()
    return _automaton


def sniff(value: bytes | None) -> list[tuple[str, int, int]]:
    """(media type, offset, length) of every valid medium in the value, by offset."""
    if not value:
        return []
    found, within_gzip, marks = [], -1, Marks(value)
    for last, (n, kind) in automaton().iter(value.decode("latin-1")):
        at = last + 1 - n
        if kind in ("zip", "gzip") and at < within_gzip:
            continue  # a further member of an archive that is already whole
        if got := VALIDATORS[kind](value, at, marks):
            found.append((got[0], at, got[1]))
            if kind in ("zip", "gzip"):
                within_gzip = at + got[1]
    return sorted(found, key=lambda x: (x[1], -x[2], x[0]))


def wave(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit unsigned mono PCM of the payload, one sample a byte."""
    pad = len(payload) & 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + b"\0" * pad


def samples(value: bytes, at: int = 0) -> bytes:
    """The data chunk of the WAVE medium at that offset."""
    pos = at + 12
    while True:
        kind, n = struct.unpack_from("<4sI", value, pos)
        if kind == b"data":
            return value[pos + 8 : pos + 8 + n]
        pos += 8 + n + (n & 1)


def padded(raw: bytes, unit: int = 64) -> bytes:
    """Bytes 0 are appended up to a positive multiple of the unit."""
    return raw + b"\0" * (-len(raw) % unit if raw else unit)


STORED = "doc_id long, n_bytes long, declared string, media binary"
SNIFFED = "doc_id long, declared string, media_type string, found array<struct<media_type: string, offset: long, length: long>>"


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """Each text's UTF-8 bytes, padded, as a media column."""

    def run(batches):
        for b in cut(batches):
            raw = [(t or "").encode("utf-8") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array([declared] * len(raw)), pa.array([wave(padded(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    return documents(df, id_col, text_col).mapInArrow(run, STORED)


def sniff_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """The corrected type of each value and all valid media found in it."""

    def run(batches):
        for b in cut(batches, column="media"):
            found = [sniff(v) for v in b.column("media").to_pylist()]
            declared = b.column("declared").to_pylist()
            true = [next((k for k, at, _ in f if at == 0), d) for f, d in zip(found, declared)]
            spans = [[{"media_type": k, "offset": at, "length": n} for k, at, n in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(declared, pa.string()), pa.array(true, pa.string()), pa.array(spans, pa.list_(pa.struct([("media_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))], names=["doc_id", "declared", "media_type", "found"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"), F.col(declared_col).alias("declared")).mapInArrow(run, SNIFFED)


def carve_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row with the bytes of each medium that is embedded in a value (found after its first byte)."""

    def run(batches):
        for b in cut(batches, column="media"):
            for i, v in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist()):
                rows = [(i, k, at, v[at : at + n]) for k, at, n in sniff(v) if at]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.binary()))], names=["doc_id", "media_type", "offset", "media"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, "doc_id long, media_type string, offset long, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(doc_id, n_bytes, declared, media: bytes):
    found = sniff(media)
    kind = next((k for k, at, _ in found if at == 0), declared)
    payload = samples(media) if kind == "audio/wav" else media
    feature = ";".join([f"{declared}>{kind}", *[f"{k}@{at}+{n}" for k, at, n in found]])
    return doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_digest(stored: DataFrame) -> DataFrame:
    """Sniffs the stored values, reads their samples back and takes the digests of the query."""
    fields = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches):
        for b in cut(batches, column="media"):
            rows = [digest(*x) for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "declared", "media")))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    return stored.mapInArrow(run, DIGEST)
