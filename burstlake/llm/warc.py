"""WARC archives: one gzip member per record, written by the tasks and read back record by record."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir

# Fixed values of the format (WARC 1.1, ISO 28500).
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"


def open_uri(uri: str, mode: str):
    """A stream on a local path, a file: path, or whatever store Arrow's file systems reach."""
    if uri.startswith("file:"):
        uri = re.sub(r"^file:/*", "/", uri)
    if "://" not in uri:
        return open(uri, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path, compression=None) if "w" in mode else store.open_input_stream(path, compression=None)


def make_folder(uri: str) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", uri) if uri.startswith("file:") else uri)
    store.create_dir(path, recursive=True)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str | None, payload: bytes, refers_to: str | None, date: str, level: int) -> bytes:
    """One record as a gzip member; a revisit keeps the HTTP head, with the length of the payload that it leaves out."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if kind == "revisit" else head + payload
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {quote(uri, safe=''.join(map(chr, range(33, 127))))}")
    lines += [f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}", f"Content-Type: {HTTP_TYPE}", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{refers_to}>"]
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def _members(stream, chunk: int) -> Iterator[bytes]:
    """The gzip members of a stream, each inflated piece by piece as its bytes come in."""
    inflate, parts, data = None, [], stream.read(chunk)
    while data:
        inflate = inflate or zlib.decompressobj(31)
        parts.append(inflate.decompress(data))
        if inflate.eof:
            yield b"".join(parts)
            data, inflate, parts = inflate.unused_data, None, []
        else:
            data = b""
        data = data or stream.read(chunk)
    if inflate is not None:
        raise ValueError("the archive ends inside a gzip member")


def read_stream(stream, chunk: int = 1 << 18) -> Iterator[dict]:
    """Records in order: headers (lower-case names), block and payload, framed by Content-Length, their digests verified."""
    for data in _members(stream, chunk):
        end = data.find(b"\r\n\r\n")
        first, *lines = data[: max(end, 0)].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not first.startswith("WARC/"):
            raise ValueError("no WARC record at the start of a gzip member")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers["content-length"])
        block, rest = data[end + 4 : end + 4 + length], data[end + 4 + length :]
        if len(block) != length or rest != b"\r\n\r\n":
            raise ValueError("a record does not have its Content-Length")
        head = block.find(b"\r\n\r\n")
        http = headers.get("content-type", "").startswith("application/http") and head >= 0
        payload, kept = (block[head + 4 :] if http else block), None
        if http and (m := re.search(rb"\r\ncontent-length:[ ]*(\d+)", block[:head], re.I)):
            kept = int(m[1])
        whole = headers.get("warc-type") != "revisit"
        good = all(name not in headers or headers[name] == _sha1(x) for name, x in (("warc-block-digest", block), *([("warc-payload-digest", payload)] if whole else [])))
        yield {"headers": headers, "payload": payload if whole else None, "payload_bytes": len(payload) if whole or kept is None else kept, "verified": good}


def _written(folder: str, rotate: int, date: str, level: int):
    def run(batches):
        out = path = None
        size = records = 0
        for b in batches:
            for record_id, uri, html, kind, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    path = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
                    out, size, records = open_uri(path, "wb"), 0, 0
                data = record(kind, record_id, uri, html.encode("utf-8", "surrogatepass"), refers_to, date, level)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= rotate:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

    return run


def write_warc(pages: DataFrame, folder: str, least: int = 1000, rotate: int = 64 << 20, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write pages(page_id, url, html) as archives under folder; path, records and bytes of each archive.

    Of records with equal payloads of at least `least` bytes the one with the largest page_id is a response and the others
    revisit it; rows that repeat that page_id are responses too, and so is all where no page_id of the group is known. A
    task that runs again writes archives of another name; the returned table lists each record once. Other columns are
    ignored; a null url leaves out its header; an empty table gives no archives."""
    make_folder(folder)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    known = known.withColumn("digest", F.when(F.octet_length("html") >= least, F.sha1(F.col("html").cast("binary"))))
    first = known.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    again = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    rows = known.join(cut(first, "repeated"), "digest", "left").withColumn("again", again)
    rows = rows.select(urn("page_id").alias("record_id"), "url", "html", F.when(F.col("again"), "revisit").otherwise("response").alias("kind"), F.when(F.col("again"), urn("first")).alias("refers_to"))
    return cut(rows.mapInArrow(_written(folder, rotate, date, level), "path string, records long, bytes long"), "archives")


def _read(chunk: int, payloads: bool):
    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with open_uri(path, "rb") as stream:
                    for r in read_stream(stream, chunk):
                        h = r["headers"]
                        name = h.get("warc-payload-digest", "")
                        digest = base64.b32decode(name[5:]).hex() if name.startswith("sha1:") else None
                        rows.append((path, h.get("warc-type"), h.get("warc-record-id", "").strip("<>"), h.get("warc-refers-to", "").strip("<>") or None, h.get("warc-target-uri"), r["payload_bytes"], digest, r["verified"], r["payload"] if payloads else None))
                        held += len(r["payload"] or b"") * payloads + 200
                        if held > 4 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows)

    return run


_FIELDS = [("path", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("verified", pa.bool_()), ("payload", pa.binary())]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)], [n for n, _ in _FIELDS])


def read_warc(archives: DataFrame, payloads: bool = False, chunk: int = 1 << 18) -> DataFrame:
    """Records of the archives in archives(path, ...), each archive read in sequence by one task.

    path, record_type, record_id, refers_to, uri, payload_bytes, payload_digest (hex), verified, payload (null unless asked
    for, and in revisits). A record with a wrong digest has verified false; a broken frame raises."""
    shape = "path string, record_type string, record_id string, refers_to string, uri string, payload_bytes long, payload_digest string, verified boolean, payload binary"
    n = max(1, archives.count())  # a task for each archive
    return archives.select("path").repartition(n).mapInArrow(_read(chunk, payloads), shape)


def pages_by_warc(spark: SparkSession, pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, verified: pages written as archives and read back.

    One row per row of pages: a null html has no bytes, a null page_id stays null, repeated rows are records of their own,
    other columns are ignored, an empty table gives no rows."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    back = read_warc(write_warc(pages, folder, least))
    return back.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "verified")


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT html, max(page_id) AS first, count(*) AS m FROM p WHERE n >= 1000 GROUP BY html HAVING count(*) > 1)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN g.first IS NOT NULL AND p.page_id IS DISTINCT FROM g.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.first IS NOT NULL AND p.page_id IS DISTINCT FROM g.first THEN g.first END AS refers_to,
       true AS verified
FROM p LEFT JOIN g ON p.n >= 1000 AND p.html = g.html
"""
