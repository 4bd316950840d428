"""WARC files from legacy ARC archives.

An ARC file starts with a version block that names the fields of its header lines; version
1 has five of them, version 2 ten, and the last is always the record's declared length. The
converter reads the header line by these names and exactly as many bytes as declared, then
synthesises the WARC record: an identifier derived from the record's own, a timestamp from
the 14-digit date, type response or revisit, payload and block digests (base32 SHA-1).

An archive on disk is plain or gzip-compressed, of one member or one for each record. read_arc_files()
reads the ARC files at a path, from any store that Spark reads; convert_files() turns them into WARC
files. Of records with equal payloads of at least `least` bytes, the one with the smallest
page id is the response, others revisit it; which that is comes from an aggregation over digests, so no
payload is compared with another. round_trip() writes web pages as ARC files (both versions, the page id in
an HTTP header), converts these files and reads the WARC files.

Files are written by Spark's text writer, so they go to any file system and a lost task is
written anew. A row of that writer is one file: whole records of FILE_BYTES together (or one longer
record), joined by what ends a record in that format, which is also the writer's line
separator. Such a file is one gzip member, as the writer cannot end a member after
each record. A file is read as a whole, so it must stay below 2 GB. Reading goes by declared
lengths alone and checks every digest.

Extension fields X-Page-Id and X-Refers-To-Page-Id carry page ids, X-Payload-Length the size of
the payload that a revisit leaves out.

Defined cases: null html is an empty payload; null url is written as "-"; blanks and
control characters in a url are percent-encoded; a null page id never is a group's smallest
(if all are null, all are responses); rows of one id and payload all have its type and
one identifier; records of ARC files without X-Page-Id have null page ids; an
empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshift.session import scratch, ship, staged

#: Fixed values of the two formats.
VERSION_1 = "URL IP-address Archive-date Content-type Archive-length"
VERSION_2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
END = b"\r\n\r\n"

ARCHIVED, ADDRESS, LEAST = "20200101000000", "0.0.0.0", 0
#: Bytes of records that a file holds before compression, if no record is longer.
FILE_BYTES = 16 << 20
ARC_END, WARC_END = "\n", "\r\n\r\n"
FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ARC -------------------------------------------------------------------------------------------------


class ArcRecord(NamedTuple):
    fields: dict[str, str]
    content: bytes
    version: int


def arc_header(version: int, url: str, mime: str, content: bytes, date: str = ARCHIVED, name: str = "pages.arc") -> bytes:
    """A record's header line."""
    if version == 1:
        return f"{url} {ADDRESS} {date} {mime} {len(content)}\n".encode()
    return f"{url} {ADDRESS} {date} {mime} 200 {digest(content)} - 0 {name} {len(content)}\n".encode()


def arc_start(version: int, date: str = ARCHIVED, name: str = "pages.arc") -> bytes:
    """The version block, with its header line."""
    block = f"{version} 0 lexshift\n{VERSION_1 if version == 1 else VERSION_2}\n".encode()
    return arc_header(version, f"filedesc://{name}", "text/plain", block, date, name) + block


def arc_file(version: int, records: list[tuple[str, bytes]], date: str = ARCHIVED, name: str = "pages.arc") -> bytes:
    """An ARC file of (url, http response) records."""
    parts = [arc_start(version, date, name), b"\n"]
    for url, content in records:
        parts += [arc_header(version, url, "text/html", content, date, name), content, b"\n"]
    return b"".join(parts)


def read_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """The records after the version block, by their declared lengths. Blank lines between records are passed over."""

    def exactly(n: int) -> bytes:
        got = stream.read(n)
        if len(got) != n:
            raise ValueError(f"ARC record ends after {len(got)} of {n} bytes")
        return got

    names, version = None, 0
    while line := stream.readline():
        if not line.strip():
            continue
        words = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if names is None:
            if not words[0].startswith("filedesc://"):
                raise ValueError("ARC file has no version block")
            described = exactly(int(words[-1])).decode("utf-8", "replace").split("\n")
            version, names = int(described[0].split(" ")[0]), described[1].strip().split(" ")
            continue
        spare = len(words) - len(names)
        if spare < 0:
            raise ValueError(f"ARC header line has {len(words)} of {len(names)} fields")
        fields = dict(zip(names, [" ".join(words[: spare + 1]), *words[spare + 1 :]]))  # old crawlers left blanks in urls
        yield ArcRecord(fields, exactly(int(fields["Archive-length"])), version)


# WARC ------------------------------------------------------------------------------------------------


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def _warc(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the blank lines that end it."""
    lines = [b"WARC/1.0", *(f"{k}: {v}".encode() for k, v in [*headers, ("Content-Length", str(len(block)))])]
    return b"\r\n".join(lines) + END + block


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP headers, with the blank line that ends them, and payload. Content without such headers is all payload."""
    if content[:5] == b"HTTP/":
        at = content.find(END)
        if at >= 0:
            return content[: at + 4], content[at + 4 :]
    return b"", content


def convert(arc: ArcRecord, page_id: int | None, first: int | None) -> bytes:
    """One ARC record as a WARC record. first: the page id of the response that has this payload, if known."""
    http, payload = split_http(arc.content)
    name = lambda i: record_id(f"page:{i} {digest(payload)}")
    again = first is not None and first != page_id
    block = http if again else arc.content
    when = datetime.strptime(arc.fields["Archive-date"][:14].ljust(14, "0"), "%Y%m%d%H%M%S")
    headers = [
        ("WARC-Type", "revisit" if again else "response"),
        ("WARC-Record-ID", name(page_id) if page_id is not None else record_id(f"{arc.fields['URL']} {digest(payload)}")),
        ("WARC-Date", when.strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Target-URI", arc.fields["URL"]),
        ("WARC-IP-Address", arc.fields["IP-address"]),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if again:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", name(first)), ("X-Refers-To-Page-Id", str(first)), ("X-Payload-Length", str(len(payload)))]
    return _warc(headers, block)


def read_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record, by their declared lengths."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
            headers[key.lower()] = value
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("WARC record is cut off")
        yield headers, block


def summary(headers: dict[str, str], block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to. The payload's size of a revisit is told by a field of its own."""
    _, payload = split_http(block)
    told, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
    if kind == "revisit":
        size = int(headers["x-payload-length"])
    else:
        size = len(payload)
        if digest(payload) != told:
            raise ValueError(f"payload digest of {headers['warc-record-id']} is wrong")
    number = lambda k: int(headers[k]) if k in headers else None
    return number("x-page-id"), size, told, kind, number("x-refers-to-page-id")


# In Spark --------------------------------------------------------------------------------------------


def clean_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f\x85\xa0\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "-"


class _Unzipped(io.RawIOBase):
    """The bytes of gzip data, member after member, a piece at a time."""

    def __init__(self, data):
        self.data, self.at, self.zip, self.rest = memoryview(data), 0, zlib.decompressobj(31), b""

    def readable(self):
        return True

    def readinto(self, into) -> int:
        while True:
            if self.zip.eof:
                left = self.zip.unused_data
                if not left and self.at >= len(self.data):
                    return 0
                self.zip, self.rest = zlib.decompressobj(31), left
            feed = self.zip.unconsumed_tail or self.rest
            if not feed:
                feed = self.data[self.at : self.at + 65536]
                self.at += len(feed)
            self.rest = b""
            got = self.zip.decompress(feed, len(into))
            if got:
                into[: len(got)] = got
                return len(got)
            if not len(feed) and not self.zip.eof:
                return 0


def opened(data: bytes) -> BinaryIO:
    """A stream over an archive's bytes, compressed or not."""
    return io.BufferedReader(_Unzipped(data), 1 << 16) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def _files(records: Iterator[bytes], end: bytes, file_bytes: int, start=lambda number: []):
    """Batches of one row: the records of a file, joined by end; start(number) gives what a file begins with."""
    held, size, number = [], 0, 0

    def made():
        return pa.RecordBatch.from_arrays([pa.array([end.join([*start(number), *held])], pa.large_binary()).cast(pa.binary())], names=["file"])

    for record in records:
        if held and size + len(record) > file_bytes:
            yield made()
            held, size, number = [], 0, number + 1
        held.append(record)
        size += len(record)
    if held:
        yield made()


def _write(files: DataFrame, path: str, end: str) -> None:
    files.select(F.col("file").cast("string").alias("value")).write.options(lineSep=end, compression="gzip", maxRecordsPerFile=1).text(path)


def write_arc(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """(page_id, url, html) as compressed ARC files at path; every other task writes version 2."""
    ship(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html")
    )

    def run(batches):
        def records():
            for batch in batches:
                for page, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html"))):
                    payload, known = html.as_py(), f"X-Page-Id: {page.as_py()}\r\n" if page.is_valid else ""
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(payload)}\r\n\r\n".encode()
                    yield clean_url(url.as_py()), http + payload

        version = 1 + TaskContext.get().partitionId() % 2
        made = (arc_header(version, url, "text/html", content) + content for url, content in records())
        yield from _files(made, ARC_END.encode(), file_bytes, lambda number: [arc_start(version)])

    _write(rows.mapInArrow(run, "file binary"), path, ARC_END)


ARC_ROWS = "page_id long, url string, address string, date string, version int, payload_bytes long, payload_digest string, content binary"


def read_arc_files(spark: SparkSession, path: str, contents: bool = True) -> DataFrame:
    """The records of the ARC files at path (plain or gzip): page_id (of the HTTP header X-Page-Id, else null), url, address,
    date, version, payload_bytes, payload_digest and, if asked for, content."""
    ship(spark)
    schema = ARC_ROWS if contents else ARC_ROWS.removesuffix(", content binary")
    names, step = [c.split()[0] for c in schema.split(", ")], 8 << 20

    def run(batches):
        def made(rows):
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
            columns = zip(*rows) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for arc in read_arc(opened(content.as_buffer().to_pybytes())):
                    http, payload = split_http(arc.content)
                    page = re.search(rb"(?i)\r\nx-page-id: *(-?[0-9]+)\r\n", http)
                    row = int(page[1]) if page else None, arc.fields["URL"], arc.fields["IP-address"], arc.fields["Archive-date"], arc.version, len(payload), digest(payload)
                    rows.append((*row, arc.content) if contents else row)
                    size += len(arc.content) if contents else 200
                    if size > step:
                        yield made(rows)
                        rows, size = [], 0
                yield made(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def convert_files(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> None:
    """The ARC files at one path as compressed WARC files at another."""
    sums = read_arc_files(spark, arc_path, contents=False).filter(F.col("payload_bytes") >= least)
    sums = sums.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    firsts = staged(sums.select("payload_digest", "first"), "first-responses")
    rows = read_arc_files(spark, arc_path).join(firsts, "payload_digest", "left").select("page_id", "url", "address", "date", "version", "first", "content")

    def run(batches):
        def records():
            for batch in batches:
                for page, url, address, date, version, first, content in zip(*batch.columns):
                    arc = ArcRecord({"URL": url.as_py(), "IP-address": address.as_py(), "Archive-date": date.as_py()}, content.as_py(), version.as_py())
                    yield convert(arc, page.as_py(), first.as_py())

        yield from _files(records(), WARC_END.encode(), file_bytes)

    _write(rows.mapInArrow(run, "file binary"), warc_path, WARC_END)


def _read(batches):
    names = [c.split()[0] for c in FOUND.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=names)

    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for headers, block in read_warc(opened(content.as_buffer().to_pybytes())):
                rows.append(summary(headers, block))
                if len(rows) >= 4096:
                    yield made(rows)
                    rows = []
            yield made(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """What the archives at path hold: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, FOUND)


def round_trip(pages: DataFrame, least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    spark = pages.sparkSession
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(pages, arc, file_bytes)
    convert_files(spark, arc, warc, least, file_bytes)
    return read_records(spark, warc)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT page_id, octet_length(body) AS n, hex,
  list_reduce(list_transform(string_split(hex, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', c) - 1) + 1, 4)), lambda a, b: a || b) AS b FROM p),
first AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(b, CAST(5 * i + 1 AS BIGINT), 1) AS INT) + 8 * CAST(substr(b, CAST(5 * i + 2 AS BIGINT), 1) AS INT) + 4 * CAST(substr(b, CAST(5 * i + 3 AS BIGINT), 1) AS INT)
      + 2 * CAST(substr(b, CAST(5 * i + 4 AS BIGINT), 1) AS INT) + CAST(substr(b, CAST(5 * i + 5 AS BIGINT), 1) AS INT), 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id IS NULL OR first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits JOIN first USING (hex)
"""
