"""WARC archives with revisit records: resolve copies by payload digest, write, and read back."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repset.llm.store import Store
from repset.llm.worker import bounded, tidy
from repset.session import materialize, scratch

#: payloads below this many bytes are never revisits
LEAST_BYTES = 100
#: revisit headers are broadcast to the writers up to this many rows of about 100 bytes; beyond, joined by shuffle
BROADCAST_ROWS = 300_000
#: a file is closed when it has this many bytes
FILE_BYTES = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, digest, first``: the headers that revisit the response ``first``.

    Only headers are shuffled, by digest; the smallest page_id of each digest is found with a
    combined minimum, so a payload shared by a third of all pages stays spread out."""
    h = pages.select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("bytes"), F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"))
    h = h.where(F.col("bytes") >= LEAST_BYTES).select("page_id", "digest")
    h, _ = materialize(h, "headers")
    first = h.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    first, _ = materialize(first, "firsts")
    if first.count() <= BROADCAST_ROWS:  # a payload of very many pages is then no key of a shuffle
        first = F.broadcast(first)
    return h.join(first, "digest").where("NOT page_id <=> first").select("page_id", "digest", "first").distinct()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _clean(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record, with its closing blank lines."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    body = http + payload if refers_to is None else http
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


@tidy
def _write(batches: Iterator[pa.RecordBatch], uri: str, date: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    store, part = Store(uri), TaskContext.get().partitionId()
    rows = ((p, u, (h or "").encode(), f) for b in batches for p, u, h, f in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True))
    ahead = next(rows, None)
    k = 0
    while ahead is not None:
        n = 0

        def members() -> Iterator[bytes]:
            nonlocal ahead, n
            size = 0
            while ahead is not None and size < FILE_BYTES:
                m = _member(record(*ahead, date))
                size, n = size + len(m), n + 1
                yield m
                ahead = next(rows, None)

        name = f"part-{part:06d}-{k:04d}.warc.gz"
        size = store.put(name, members())
        yield pa.RecordBatch.from_pylist([{"name": name, "records": n, "bytes": size}], schema=pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))
        k += 1


def write_archives(pages: DataFrame, uri: str, date: str | None = None) -> DataFrame:
    """Write every page as a gzip member of WARC files below ``uri``; returns the manifest (name, records, bytes)."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    Store(uri).create()
    revisits, _ = materialize(resolve_revisits(pages), "revisits")
    r = revisits.select(F.col("page_id").alias("p"), F.col("digest").alias("g"), "first")
    if revisits.count() <= BROADCAST_ROWS:
        r = F.broadcast(r)
    full = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"))
    full = full.join(r, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("g")), "left").select("page_id", "url", "html", "first")
    return materialize(full.mapInArrow(lambda it: _write(it, uri, date), "name string, records long, bytes long"), "manifest")[0]


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzip WARC stream; one record is held at a time."""
    buf, z, out = b"", zlib.decompressobj(31), []
    while True:
        if not buf:
            buf = stream.read(1 << 16)
            if not buf:
                break
        out.append(z.decompress(buf))
        buf = b""
        if z.eof:
            buf, z = z.unused_data, zlib.decompressobj(31)
            raw, out = b"".join(out), []
            head, _, rest = raw.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            named = dict(x.split(": ", 1) for x in lines[1:])
            n = int(named["Content-Length"])
            if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
                raise ValueError(f"not a WARC record: {lines[0][:40]}")
            yield named, rest[:n]
    if out and any(out):
        raise ValueError("the archive is cut off")


@tidy
def _read(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    store = Store(uri)
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    for b in batches:
        for name in b.column("name").to_pylist():
            rows, held = [], 0
            with store.open(name) as f:
                for h, block in parse(f):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    whole = h["WARC-Type"] == "response"
                    if whole and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"payload and digest differ in {name}")
                    rows.append({"page_id": int(h["X-Page-Id"]) if "X-Page-Id" in h else None, "url": h.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": int(h["X-Refers-To-Page-Id"]) if not whole else None, "payload": payload if whole else None})
                    held += len(payload)
                    if held > 4 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def read_archives(spark: SparkSession, uri: str, manifest: DataFrame) -> DataFrame:
    """Records of the files of ``manifest``, checked against their digests; payload is null for revisits."""
    names = manifest.select("name").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "name")
    return names.mapInArrow(lambda it: _read(it, uri), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_pages(pages: DataFrame, uri: str | None = None) -> DataFrame:
    """Write all pages (page_id, url, html) as archives and return the records read back.

    Of pages with equal payloads of at least 100 bytes the one with the smallest page_id is a
    response, the others revisit it; all smaller ones are responses. Null html is an empty payload;
    null url has no target header. A page without id can be a revisit but not an original. Repeats
    of an original's own row (same id and payload) are responses too. No rows give no files."""
    spark = pages.sparkSession
    bounded(spark)
    uri = uri or scratch(spark, "warc")
    manifest = write_archives(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), uri)
    return read_archives(spark, uri, manifest)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(strlen(html), 0)::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
 f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN f.first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND payload_bytes >= 100
"""
