"""WARC files: writing with revisits, and reading by boundary chains.

Writing: one record per row. Equal payloads are found by SHA-256 and length; only digests are
grouped. The row with the smallest id writes a `response`, the others a `revisit` that refers to
it; smaller payloads than `min_bytes` are always written whole. A record ends with CR LF CR LF,
which is the line separator of Spark's text writer, so archives are written and committed by it.
They are plain unless `compression` is "gzip", which makes one gzip stream of each file (not one
member per record). The round trip packs its files: its payloads lie on the disk a second time, in the
shuffle, and pages are stored packed, so plain archives alone may be several times the input.

Reading: tasks look for the magic string in the bytes of a file, take every place as a candidate
record, read its header and emit the candidate with its successor (header end + Content-Length +
4, if CR LF CR LF stands there). Payloads may hold whole records, so a candidate proves nothing:
starting at offset 0 of each file, pointer jumping marks the records that the chain reaches, twice
as many in each round; the rest is dropped. A chain that ends neither at a candidate nor at the
end of its file is an error.

A header is read once however many magic strings stand in it, so a payload of magic strings costs time in
proportion to its length; records nested in payloads are hashed once per nested header. Files of gzip
members are read too (offsets are those of the unpacked bytes).

Files hold at most `records_per_file` records and must stay below 2 GB, since a file is read as
one value. Defined cases: a null payload is empty; an empty payload is a payload (empty ones revisit
the first if `min_bytes` is 0); line breaks in URLs are percent-encoded and a null URL is empty;
rows with the smallest id of their payload are all responses; a null id is written as "null", read
as null and refers to nothing else first (it sorts last); an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_folder
from .shared import cut_lineage

MAGIC = b"WARC/1.1\r\n"
RECORDS_PER_FILE = 1000
#: Base-32 alphabet, revisit profile.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CANDIDATE = ("file string, at long, next long, length long, page_id long, payload_bytes long, "
             "payload_digest string, record_type string, refers_to long")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1: eight groups of 20 bits, four letters each."""
    letters = F.lit(BASE32)

    def group(hexa: Column, i: Column) -> Column:
        v = F.conv(F.substring(hexa, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(letters, F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    hexa = F.transform(F.array(F.sha1(payload)), lambda h: F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda i: group(h, i)), ""))
    return hexa[0]


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _urn(number: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(number.cast("string"), F.lit("null")), F.lit(">"))


def records(pages: DataFrame, page_id: str, url: str, html: str, min_bytes: int, date: str) -> DataFrame:
    """`record`: the text of each record without its closing CR LF CR LF."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html")).withColumn("sha", F.sha2("html", 256))
    # groups of equal payloads: digests only, combined before the shuffle
    first = rows.filter(F.col("bytes") >= min_bytes).groupBy("sha", "bytes").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "bytes", "first")
    rows = rows.join(first, ["sha", "bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes"), F.lit("\r\n\r\n"))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("html")))
    rows = rows.select("page_id", "url", "first", revisit.alias("revisit"), block.alias("block"),
                       base32_sha1(F.col("html")).alias("digest"))
    kind = F.when(F.col("revisit"), F.concat(
        F.lit("WARC-Type: revisit\r\n"), _line("WARC-Refers-To", _urn(F.col("first"))),
        _line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("WARC-Type: response\r\n"))
    return rows.select(F.concat(
        F.lit(MAGIC.decode()), kind, _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Target-URI", F.col("url")), _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), F.col("block")).alias("record"))


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
          min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE,
          compression: str = "none") -> None:
    """Archives of all rows in `folder`, plain or, with `compression` "gzip", each file one gzip stream."""
    records(pages, page_id, url, html, min_bytes, date).write.option("lineSep", "\r\n\r\n").option(
        "maxRecordsPerFile", records_per_file).option("compression", compression).text(folder)


_FIELD = re.compile(rb"^([A-Za-z-]+): (.*)$", re.M)


def _page(value: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:x-page:(-?\d+)>", value or b"")
    return int(found[1]) if found else None


class _Header:
    """The lines from `at` to the next blank line, read once for all magic strings among them."""

    def __init__(self, content: bytes, at: int):
        self.end = content.find(b"\r\n\r\n", at)
        self.last = {}  # name -> (place, value) of its last line
        if self.end >= 0:
            self.last = {m[1]: (m.start(), m[2].rstrip(b"\r")) for m in _FIELD.finditer(content, at, self.end + 2)}
        self.body = None

    def field(self, name: bytes, at: int) -> bytes:
        place, value = self.last.get(name, (-1, b""))
        return value if place >= at else b""

    def payload(self, content: bytes, stop: int) -> tuple[int, str, int]:
        """Bytes and SHA-1 of the payload, and the length that the HTTP header states. All candidates of one
        header that have a Content-Length have the same one, so this is asked for one `stop` only."""
        if self.body is None:
            begin = self.end + 4
            blank = content.find(b"\r\n\r\n", begin, stop)
            said = re.search(rb"\r\nContent-Length: (\d+)\r\n", content[begin:blank + 2]) if blank >= 0 else None
            part = memoryview(content)[blank + 4 if blank >= 0 else begin:stop]
            self.body = len(part), base64.b32encode(hashlib.sha1(part).digest()).decode(), int(said[1]) if said else 0
        return self.body


def candidates_of(content: bytes) -> list[tuple]:
    """(at, next, page_id, payload_bytes, digest, type, refers_to) at each magic string."""
    out = []
    header = None
    at = content.find(MAGIC)
    while at >= 0:
        if header is None or at > header.end:
            header = _Header(content, at)
            if header.end < 0:
                break
        size = header.field(b"Content-Length", at)
        digits = size.lstrip(b"0")
        # no length within a file has 19 digits
        stop = header.end + 4 + int(digits or b"0") if size.isdigit() and len(digits) < 19 else len(content)
        if content[stop:stop + 4] == b"\r\n\r\n":
            kind = header.field(b"WARC-Type", at).decode("utf-8", "replace")
            length, digest, said = header.payload(content, stop)
            if kind == "revisit":
                length = said
                digest = header.field(b"WARC-Payload-Digest", at).removeprefix(b"sha1:").decode("utf-8", "replace")
            out.append((at, stop + 4, _page(header.field(b"WARC-Record-ID", at)), length, digest, kind,
                        _page(header.field(b"WARC-Refers-To", at))))
        at = content.find(MAGIC, at + 1)
    return out


def plain(data: bytes) -> bytes:
    """The bytes of an archive; a chain of gzip members (one per record or any other cut) is unpacked."""
    return gzip.GzipFile(fileobj=io.BytesIO(data)).read() if data[:2] == b"\x1f\x8b" else data


def _emit(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            data = plain(content.as_py())
            found = candidates_of(data)
            cols = list(zip(*found)) if found else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            at, nxt, page, size, digest, kind, refers = [pa.array(c, t) for c, t in zip(cols, types)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(found), pa.string()), at, nxt, pa.array([len(data)] * len(found), pa.int64()),
                 page, size, digest, kind, refers],
                ["file", "at", "next", "length", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def reachable(candidates: DataFrame) -> DataFrame:
    """The candidates (file, at, next, length, ...) that the chain from offset 0 reaches."""
    jump = candidates.select("file", "at", "next")
    marks = jump.filter("at = 0").select("file", "at")
    while True:
        onward = jump.select("file", "at", F.col("next").alias("to"))
        target = jump.select("file", F.col("at").alias("to"), F.col("next").alias("beyond"))
        # marks of this round: the places that lie one jump behind the marks so far
        ahead = marks.join(onward, ["file", "at"]).select("file", F.col("to").alias("at"))
        marks = cut_lineage(marks.unionByName(ahead).distinct())
        jump = cut_lineage(onward.join(target, ["file", "to"]).select("file", "at", F.col("beyond").alias("next")))
        if jump.isEmpty():
            break
    chain = candidates.join(marks, ["file", "at"], "left_semi")
    ends = candidates.select("file", F.col("at").alias("next"))
    broken = chain.filter(F.col("next") != F.col("length")).join(ends, ["file", "next"], "left_anti")
    if not broken.isEmpty():
        raise ValueError("a record chain breaks off before the end of its file")
    return chain


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records in `folder`."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    found = cut_lineage(files.mapInArrow(_emit, CANDIDATE))
    return reachable(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, compression: str = "gzip", **how) -> DataFrame:
    """Write `pages` to a new folder beside the checkpoints and read the archives back."""
    folder = f"{scratch_folder(pages.sparkSession)}/warc"
    write(pages, folder, compression=compression, **how)
    return read(pages.sparkSession, folder)
