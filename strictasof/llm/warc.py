"""WARC archives: a writer and a splittable reader.

An archive is a row of gzip members, one per record, so it can be read from any byte. A reading task has a byte range: it
scans for the gzip magic, tries each candidate by inflating it and decoding its WARC header, and from the first that
holds reads on, member by member. It owns the records that start inside its range, the last one also where it ends beyond.
No task holds more than a block of the file and one record.

Records with equal payloads are written once: that of the smallest page id is the response, the others are revisits that
refer to it. Paths are opened with ``pyarrow.fs``, so archives may lie in any store it knows (file, hdfs, s3, gs). A
writing task gives its files names of their own and reports those it finished; only these are read, so an attempt that was
lost or run twice leaves nothing that counts.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, stage, staged_path
from .registry import query

#: an archive is closed when it has so many bytes; a reading task gets a range of so many; a read fetches so many
ARCHIVE_BYTES, RANGE_BYTES, BLOCK_BYTES = 256 << 20, 8 << 20, 1 << 20
#: how much of a candidate is inflated before its first bytes must be a WARC version line
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
RECORD = "path string, offset long, next_offset long, record_id string, record_type string, target_uri string, page_id long, " \
         "refers_to_record string, payload binary, payload_digest string"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: str, kind: str, uri: str | None, page_id, refers_to: str | None, payload: bytes, digest: str) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header of its page and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    head += [f"WARC-Target-URI: {quote(uri, safe=''.join(map(chr, range(33, 127))))}"] if uri is not None else []
    head += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    head += [f"WARC-Refers-To: <{refers_to}>",
             "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to else []
    head.append(f"Content-Length: {len(block)}")
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Staged ``pages`` (page_id, url, html) with row_id and refers_to: the row id of the equal payload's response, or null.

    Null html is the empty payload; null page ids come last; among equal ids the first row is the response.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = numbered(pages, "page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), name="pages")
    same = rows.select("digest", "page_id", "row_id", F.octet_length("html").alias("n")).where(F.col("n") >= least_bytes)
    first = same.groupBy("digest").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row_id")).alias("f"), F.count("*").alias("n"))
    shared = first.where("n > 1").select("digest", F.col("f.row_id").alias("first_row"))
    revisits = same.join(shared, "digest").where("row_id <> first_row").select("row_id", F.col("first_row").alias("refers_to"))
    return rows.join(revisits, "row_id", "left")


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``rows`` (from :func:`with_roles`) below ``folder``; the staged list of finished archives (path, bytes)."""

    def write(batches):
        files, place = _filesystem(folder)
        files.create_dir(place, recursive=True)
        done, out = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size = files.open_output_stream(f"{place}/{name}", compression=None), 0
                refers = None if r["refers_to"] is None else f"urn:x-row:{r['refers_to']}"
                payload = r["html"].encode()
                member = record_bytes(f"urn:x-row:{r['row_id']}", "revisit" if refers else "response", r["url"], r["page_id"],
                                      refers, payload, sha1_base32(payload))
                out.write(member)
                size += len(member)
                if size >= archive_bytes:
                    out.close()
                    done.append((name, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size))
        yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{n}", "bytes": s} for n, s in done],
                                         pa.schema([("path", pa.string()), ("bytes", pa.int64())]))

    return stage(rows.select("row_id", "page_id", "url", "html", "refers_to").mapInArrow(write, "path string, bytes long"), "archives")


class _Source:
    """Bytes of an open file by position, fetched block by block; keeps only what is still needed."""

    def __init__(self, file, size: int, block: int):
        self.file, self.size, self.block = file, size, block
        self.at, self.held = 0, b""

    def fetch(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at``."""
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if at < self.at or at + n > self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(min(max(n, self.block), self.size - at))
        return self.held[at - self.at:at - self.at + n]


def _member(source: _Source, at: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at ``at`` and where it ends, if it is a whole one that begins like a record."""
    inflate, parts, start, checked = zlib.decompressobj(31), [], at, False
    try:
        while not inflate.eof:
            data = source.fetch(at, 1 << 16)
            if not data:
                return None
            at += len(data)
            parts.append(inflate.decompress(data))
            if not checked and (inflate.eof or sum(map(len, parts)) >= len(VERSION)):
                if not b"".join(parts).startswith(VERSION):
                    return None
                checked = True
    except zlib.error:
        return None
    end = at - len(inflate.unused_data)
    return (b"".join(parts), end) if end > start else None


def parse_record(content: bytes) -> dict | None:
    """Fields of one inflated record, or None where its header and length do not hold."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    fields = {k.strip().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
    if not gap or not fields.get(b"content-length", "").isdigit() or int(fields[b"content-length"]) + 4 != len(rest):
        return None
    block = rest[:-4]
    kind = fields.get(b"warc-type")
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    digest = sha1_base32(payload) if payload is not None else fields.get(b"warc-payload-digest", "").removeprefix("sha1:")
    bare = lambda k: fields[k].strip("<>") if k in fields else None
    return {"record_id": bare(b"warc-record-id"), "record_type": kind, "target_uri": fields.get(b"warc-target-uri"),
            "page_id": int(fields[b"x-page-id"]) if b"x-page-id" in fields else None, "refers_to_record": bare(b"warc-refers-to"),
            "payload": payload, "payload_digest": digest}


def records_in(source: _Source, first: int, last: int):
    """(offset, end, fields) of the records that start in [first, last)."""
    at, last = first, min(last, source.size)
    while at < last:
        window = source.fetch(at, len(MAGIC))  # where one record ends the next begins, as a rule
        if window != MAGIC:
            window = source.fetch(at, min(source.block, last - at + len(MAGIC) - 1))
        found = window.find(MAGIC)
        if found < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += found
        member = _member(source, at) if at < last else None
        fields = parse_record(member[0]) if member else None
        if fields is None:
            at += 1
            continue
        yield at, member[1], fields
        at = member[1]


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All records of ``archives`` (path, bytes), each read by the task in whose byte range it starts."""
    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("first"))
    ranges = ranges.repartition(max(1, ranges.count()), F.col("path"), F.col("first"))
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("next_offset", pa.int64()), ("record_id", pa.string()),
                        ("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()),
                        ("refers_to_record", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string())])

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                files, place = _filesystem(r["path"])
                with files.open_input_file(place) as file:
                    rows, held = [], 0
                    for at, end, fields in records_in(_Source(file, r["bytes"], block_bytes), r["first"], r["first"] + range_bytes):
                        rows.append({"path": r["path"], "offset": at, "next_offset": end, **fields})
                        held += len(fields["payload"] or b"")
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.mapInArrow(read, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Records with payload_bytes, and refers_to: the page id of a revisit's response, whose payload it shares.

    The records' facts are stored first: the archives are read once, and the join is planned by their true size rather
    than that of the short list of archives they come from.
    """
    sized = stage(records.select("record_id", "record_type", "page_id", "refers_to_record", "payload_digest",
                                 F.octet_length("payload").cast("long").alias("payload_bytes")), "records")
    held = sized.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"),
        F.col("payload_digest").alias("_digest"))
    return sized.join(held, "refers_to_record", "left").select(
        "page_id", "record_id", "record_type", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
        F.coalesce("_digest", "payload_digest").alias("payload_digest"), "refers_to")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: five hexadecimal digits are four letters of base 32
_BASE32 = " || ".join(f"substr('{_LETTERS}', (CAST('0x' || substr(h, CAST(5 * i + 1 AS INTEGER), 5) AS INTEGER) >> {s} & 31) + 1, 1)"
                      for s in (15, 10, 5, 0))
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, row_number() OVER g AS n, first_value(page_id) OVER g AS first FROM p WINDOW g AS (PARTITION BY h ORDER BY page_id NULLS LAST))
SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(8), lambda i: {_BASE32}), '') AS payload_digest,
  CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN first END AS refers_to
FROM r
"""


@query("op8_warc", ORACLE)
def op8_warc(spark, sf_dir):
    """Every page written as a record and read back by byte ranges."""
    rows = with_roles(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    archives = write_archives(rows, staged_path(spark, "warc"))
    return resolved(read_archives(archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
