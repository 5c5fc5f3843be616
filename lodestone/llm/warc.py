"""WARC archives as a chunked record table.

Payloads travel as rows of (record, chunk number, bytes): the plan cuts a payload into chunks in the
JVM, and the writer streams them into gzip members with a running digest, so a Python worker never
holds a whole record. The reader streams a stretch of an archive the same way and gives chunk rows
with the digest of all bytes so far; the last chunk's digest is the payload's and is held against
the header's.

Records with equal payloads of at least `least` bytes: the one with the largest page_id is the
response, the others are revisits that refer to it and hold no payload.

Defined results: a null payload is empty; a null url leaves out the target; a null page_id is kept
and counts as smaller than any other; rows that share the largest page_id are all responses; every
record has an id of its own (its task and number), and a revisit names the page and its target; an
empty table writes no archive. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .deal import dealt
from .runtime import cut, drop, shared_dir, small, written

CHUNK = 1 << 16
#: An archive file is closed after so many bytes; a stretch that one task reads begins after so many.
FILE_BYTES = 1 << 28
STRETCH_BYTES = 1 << 23
DATE = "1970-01-01T00:00:00Z"
URN = "urn:lodestone:page:"
RECORD = ["page_id", "url", "n", "sha1", "record_type", "refers_to", "refers_url"]


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int, path: str) -> DataFrame:
    """page_id, url, payload, n, sha1, record_type, refers_to, refers_url. Digests that several rows share are a written table; while it has few bytes it goes to every task and no payload is shuffled."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    # summed on the map side, so a payload that a third of the rows share arrives as a row a task
    shared = rows.groupBy("sha1").agg(F.max(F.struct("page_id", "url")).alias("keep"), F.count("*").alias("c")).where("c > 1")
    shared = written(shared.select("sha1", F.lit(True).alias("shared"), F.col("keep.page_id").alias("keep"), F.col("keep.url").alias("keep_url")), path)
    own = F.col("shared").isNull() | F.col("page_id").eqNullSafe(F.col("keep")) | (F.col("n") < least)
    joined = rows.join(small(shared), "sha1", "left")
    return joined.select("page_id", "url", F.when(own, F.col("payload")).alias("payload"), "n", "sha1", F.when(own, "response").otherwise("revisit").alias("record_type"), *[F.when(~own, F.col(c)).alias(to) for c, to in (("keep", "refers_to"), ("keep_url", "refers_url"))])


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row a chunk; a record without bytes to store has one empty chunk. A record's chunks follow each other."""
    last = F.greatest(F.lit(0), (F.coalesce(F.octet_length("payload"), F.lit(0)) - 1).cast("int"))
    cut = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.floor(last / chunk).cast("int"))))
    return cut.withColumn("data", F.coalesce(F.expr(f"substring(payload, chunk_no * {chunk} + 1, {chunk})"), F.lit(b""))).drop("payload")


def header(record: str, page_id, url, n: int, sha1: str, kind: str, refers_to, refers_url) -> tuple[bytes, bytes]:
    """The record's header block and, before the payload, its HTTP block. record: a part of the record's id that no other record has."""
    stored = n if kind == "response" else 0
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    name, uri = lambda i: "null" if i is None else str(i), lambda u: quote(u, safe=":/?#[]@!$&()*+,;=%~'")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{name(page_id)}:{record}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {uri(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(sha1))}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page: {name(refers_to)}"]
        if refers_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {uri(refers_url)}")
    lines += ["Content-Type: application/http;msgtype=response", f"X-Page: {name(page_id)}", f"X-Payload-Length: {n}", f"Content-Length: {len(http) + stored}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


class ArchiveWriter:
    """Streams chunk rows into archive files; gives (path, offset, length, records) of stretches."""

    def __init__(self, uri: str, task: int):
        self.uri, self.task, self.number, self.out, self.done = uri, task, 0, None, []
        self.left, self.records = 0, 0

    def start(self, page_id, url, n, sha1, kind, *refers) -> None:
        if self.out is None:
            self.path = f"{self.uri}-{self.number:05d}.warc.gz"
            self.out, self.number, self.offset, self.count = files.Writer(self.path), self.number + 1, 0, 0
        self.pack, self.digest, self.sha1, self.kind = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1(), sha1, kind
        self.left = n if kind == "response" else 0
        for block in header(f"{self.task}.{self.records}", page_id, url, n, sha1, kind, *refers):
            self.out.write(self.pack.compress(block))
        self.records += 1

    def chunk(self, data: bytes) -> None:
        self.digest.update(data)
        self.out.write(self.pack.compress(data))
        self.left -= len(data)

    def end(self) -> None:
        if self.left or (self.kind == "response" and self.digest.hexdigest() != self.sha1):
            raise ValueError("a record's chunks don't add up to its payload")
        self.out.write(self.pack.compress(b"\r\n\r\n") + self.pack.flush())
        self.count += 1
        if self.out.size - self.offset >= STRETCH_BYTES:
            self.stretch()
        if self.out.size >= FILE_BYTES:
            self.close()

    def stretch(self) -> None:
        if self.out.size > self.offset:
            self.done.append((self.path, self.offset, self.out.size - self.offset, self.count))
        self.offset, self.count = self.out.size, 0

    def close(self) -> None:
        if self.out is not None:
            self.stretch()
            self.out.close()
            self.out = None


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Writes the archives and gives the table of their stretches (path, offset, length, records)."""
    spark: SparkSession = pages.sparkSession
    folder = shared_dir(spark, "warc")

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        out, begun = ArchiveWriter(f"{folder}/part-{task:06d}", task), False
        for b in cut(batches, column="data"):
            for k, data, *record in zip(*(b.column(c).to_pylist() for c in ("chunk_no", "data", *RECORD))):
                if k == 0:
                    if begun:
                        out.end()
                    out.start(*record)
                    begun = True
                out.chunk(data)
        if begun:
            out.end()
        out.close()
        if out.done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out.done)], names=["path", "offset", "length", "records"])

    rows = chunked(records(pages, id_col, url_col, payload_col, least, f"{folder}/shared")).select(*RECORD, "chunk_no", "data")
    stretches = written(rows.mapInArrow(run, "path string, offset long, length long, records long"), f"{folder}/stretches")
    drop(spark, f"{folder}/shared")
    return stretches


class Inflated:
    """A stream of concatenated gzip members, some bytes at a time."""

    def __init__(self, file, offset: int, length: int):
        self.file, self.at, self.end = file, offset, offset + length
        self.pack, self.raw, self.buffer = zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        while True:
            if self.pack.eof:
                self.raw, self.pack = self.pack.unused_data or self.raw, zlib.decompressobj(31)
            elif self.pack.unconsumed_tail:
                self.raw = self.pack.unconsumed_tail
            if not self.raw:
                if self.at >= self.end:
                    return False
                self.raw = self.file.read_at(min(CHUNK, self.end - self.at), self.at)
                self.at += len(self.raw)
            data, self.raw = self.pack.decompress(self.raw, CHUNK), b""
            if data:
                self.buffer += data
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with the mark; None at the end."""
        while (k := self.buffer.find(mark)) < 0:
            if not self.more():
                return None
        out, self.buffer = self.buffer[: k + len(mark)], self.buffer[k + len(mark) :]
        return out

    def some(self, most: int) -> bytes:
        if not self.buffer and not self.more():
            raise ValueError("an archive ends within a record")
        out, self.buffer = self.buffer[:most], self.buffer[most:]
        return out

    def exactly(self, n: int) -> bytes:
        parts = []
        while n:
            parts.append(self.some(n))
            n -= len(parts[-1])
        return b"".join(parts)


def read_records(file, offset: int, length: int, chunk: int = CHUNK):
    """Chunk rows of a stretch: (page_id, url, record_type, refers_to, chunk_no, data, bytes so far, digest so far, last, payload_bytes, payload_digest)."""
    stream = Inflated(file, offset, length)
    page = lambda x: None if x in (None, "null") else int(x)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if line)
        http = stream.until(b"\r\n\r\n")
        left = int(fields["Content-Length"]) - len(http)
        kind, declared, n = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
        own = (page(fields["X-Page"]), fields.get("WARC-Target-URI"), kind, page(fields.get("X-Refers-To-Page")))
        digest, done, k = hashlib.sha1(), 0, 0
        while True:
            data = stream.exactly(min(chunk, left))
            left, done = left - len(data), done + len(data)
            digest.update(data)
            so_far = base32(digest.digest())
            if not left and kind == "response" and (so_far != declared or done != n):
                raise ValueError(f"record {own[0]}: the payload doesn't match its digest")
            yield *own, k, data, done, so_far, not left, n, declared
            k += 1
            if not left:
                break
        if stream.exactly(4) != b"\r\n\r\n":
            raise ValueError(f"record {own[0]} has a wrong length")


CHUNKS = "page_id long, url string, record_type string, refers_to long, chunk_no int, data binary, bytes_so_far long, digest_so_far string, last boolean, payload_bytes long, payload_digest string"


def read(stretches: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives; a task reads whole stretches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(CHUNKS))
    batch = 256 if with_data else 4096

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        rows = []
        for b in batches:
            for path, offset, length in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length"))):
                for r in read_records(files.read_at(path), offset, length):
                    rows.append(r if with_data else (*r[:5], None, *r[6:]))
                    if len(rows) == batch:
                        yield table(rows)
                        rows = []
        if rows:
            yield table(rows)

    return dealt(stretches.select("path", "offset", "length"), "path", "offset").mapInArrow(run, CHUNKS)


def payloads(chunks: DataFrame) -> DataFrame:
    """Per record its last chunk's counts and digest: those of the bytes read back, for revisits those that the record states."""
    return chunks.where("last").select("page_id", "payload_bytes", F.when(F.col("record_type") == "response", F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
