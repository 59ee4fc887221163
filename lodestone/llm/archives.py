"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

Tasks write real .warc.gz files of about FILE_BYTES into the shared folder and
return their names; the kept table of names, committed by Spark, says which
files count, so files of lost or repeated tasks are never read.  The reader
inflates member by member from fixed-size blocks, frames records by
content-length and verifies block and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import steady
from .store import Scratch

FILE_BYTES, BLOCK, LEVEL, MOST_HEAD = 64 << 20, 1 << 16, 6, 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks the framing or a digest."""


def b32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = LEVEL) -> bytes:
    """One record as a gzip member: a response, or a revisit of refers_to without the payload."""
    name = lambda x: "urn:page:null" if x is None else f"urn:page:{x}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name(page_id)}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url) if url else name(page_id)}", f"WARC-Payload-Digest: sha1:{b32_sha1(payload)}", f"WARC-Block-Digest: sha1:{b32_sha1(block)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{name(refers_to)}>"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


class Inflater:
    """The inflated bytes of a file's gzip members, read in fixed-size blocks and never more than asked for."""

    def __init__(self, f: BinaryIO):
        self.f, self.rest, self.ahead, self.z = f, b"", b"", None

    def open(self) -> bool:
        """Goes to the next member; whether there is one."""
        if not self.rest:
            self.rest = self.f.read(BLOCK)
        self.z, self.ahead = zlib.decompressobj(31), b""
        return bool(self.rest)

    def some(self, n: int = BLOCK) -> bytes:
        """Up to n bytes of the member; none at its end."""
        if self.ahead:
            out, self.ahead = self.ahead[:n], self.ahead[n:]
            return out
        while not self.z.eof:
            if not self.rest:
                self.rest = self.f.read(BLOCK)
                if not self.rest:
                    raise WarcError("the archive ends inside a member")
            out = self.z.decompress(self.rest, n)
            self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                return out
        return b""

    def until(self, mark: bytes, most: int = MOST_HEAD) -> bytes:
        """Bytes up to the mark, which is read too."""
        held = b""
        while (at := held.find(mark)) < 0:
            more = self.some()
            if not more or len(held) > most:
                raise WarcError("no end of a header")
            held += more
        self.ahead = held[at + len(mark) :] + self.ahead
        return held[:at]


def fields_of(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}


def read(f: BinaryIO, payloads: bool = True) -> Iterator[tuple]:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of each record.

    A record is framed by content-length while it is inflated and its digests grow with it, so without payloads
    memory does not depend on a record's size.  The payload is None in a revisit and without payloads.
    """
    number = lambda x: None if x.endswith(":null>") else int(x[10:-1])
    member = Inflater(f)
    while member.open():
        head = member.until(b"\r\n\r\n").decode().split("\r\n")
        if not head[0].startswith("WARC/1."):
            raise WarcError("no WARC header")
        fields = fields_of(head[1:])
        left = int(fields["content-length"])
        http = member.until(b"\r\n\r\n")
        block, payload, size, kept = hashlib.sha1(http + b"\r\n\r\n"), hashlib.sha1(), 0, []
        left -= len(http) + 4
        while left > 0 and (part := member.some(min(left, BLOCK))):
            block.update(part)
            payload.update(part)
            size, left = size + len(part), left - len(part)
            if payloads:
                kept.append(part)
        end = b""
        while len(end) < 5 and (part := member.some(5 - len(end))):
            end += part
        if left or end != b"\r\n\r\n":
            raise WarcError("content-length does not frame the record")
        b32 = lambda h: base64.b32encode(h.digest()).decode()
        if fields["warc-block-digest"] != f"sha1:{b32(block)}":
            raise WarcError(f"block digest of {fields['warc-record-id']}")
        n = int(fields_of(http.decode().split("\r\n")[1:])["content-length"])
        digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
        if kind == "response" and (size != n or b32(payload) != digest):
            raise WarcError(f"payload digest of {fields['warc-record-id']}")
        refers = fields.get("warc-refers-to")
        yield number(fields["warc-record-id"]), fields["warc-target-uri"], b"".join(kept) if payloads and kind == "response" else None, n, digest, kind, number(refers) if refers else None


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and path of a folder named by URI or plain path."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of pages whose payload another page with a smaller id has.

    Narrow rows only: digests are counted with partial aggregates, so copies of one page may be any share of rows.
    """
    narrow = pages.where(F.octet_length("html") >= least).select("page_id", F.sha1("html").alias("sha"))
    first = narrow.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return narrow.join(first, "sha").where("page_id is null or page_id > refers_to").select("page_id", "sha", "refers_to").distinct()


def write(pages: DataFrame, scratch: Scratch, folder: str, least: int = 0) -> DataFrame:
    """Writes all pages (page_id, url, html) as archives below folder and returns the kept table of files: path, records."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    again = scratch.keep(revisits(pages, least), "revisits").select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "refers_to")
    pages = pages.withColumn("sha", F.sha1("html"))
    marked = pages.join(again, pages["page_id"].eqNullSafe(again["_id"]) & (pages["sha"] == again["_sha"]), "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        stem, out, n, size, k, done = f"{base}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", None, 0, 0, 0, []
        for batch in batches:
            ids, urls, html, refers = (batch.column(c) for c in ("page_id", "url", "html", "refers_to"))
            for i in range(batch.num_rows):
                if out is None:
                    path = f"{stem}-{k:04d}.warc.gz"
                    out, n, size, k = fs.open_output_stream(path, compression=None), 0, 0, k + 1
                data = record(ids[i].as_py(), urls[i].as_py(), html[i].as_buffer().to_pybytes(), refers[i].as_py())
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    done.append((path, n))
        if out is not None:
            out.close()
            done.append((path, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done]), pa.array([x for _, x in done], pa.int64())], ["path", "records"])

    return scratch.keep(marked.mapInArrow(steady(run), "path string, records long"), "files")


FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(files: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Records of the archives in a table of files; with payloads also the html of responses (null in revisits).

    A file whose framing, digests or number of records is wrong raises WarcError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.string()] if payloads else [])]
        names = [x.split()[0] for x in FIELDS.split(", ")] + (["html"] if payloads else [])
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                rows, n, held = [], 0, 0
                with fs.open_input_stream(path, compression=None) as f:
                    for page_id, url, payload, size, digest, kind, refers in read(f, payloads):
                        rows.append((page_id, url, size, digest, kind, refers, *([payload.decode() if payload is not None else None] if payloads else [])))
                        n, held = n + 1, held + (len(payload or b"") if payloads else 100)
                        if held > 4 << 20:
                            yield table(rows)
                            rows, held = [], 0
                if n != records:
                    raise WarcError(f"{path} has {n} records of {records}")
                if rows:
                    yield table(rows)

    n = max(1, min(100_000, files.count()))
    return files.repartition(n).mapInArrow(steady(run), FIELDS + (", html string" if payloads else ""))


def round_trip(pages: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    """Writes the pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload, a null url is replaced by the record's own name, line breaks in urls are
    percent-coded.  A page is held whole to be written, a record only in blocks to be read.  Rows that repeat a page_id and html are all responses where no smaller id has that html;
    rows with a null page_id revisit any row that has one.  Extra columns are ignored; no rows give none.
    """
    folder = f"{scratch.root}/archives"
    files = write(pages, scratch, folder, least)
    return read_archives(files, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

