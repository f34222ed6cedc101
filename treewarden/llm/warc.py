"""WARC archives: one gzip member per record, and a sequential reader.

The reader inflates a file piece by piece with zlib, starts anew at each member's end, takes a record's header up to the
empty line and its block by content-length, and checks the digests; it never holds a whole file.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_marked, marks, maybe_marked, shared_dir, slices, written

LEAST_REVISIT = 100
#: Parts that the pages of one payload are dealt over.
SALTS = 16
MANIFEST = "path string, store string, n_records long"
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(fields: list[tuple[str, str]], block: bytes, level: int = 3) -> bytes:
    """One record as one gzip member."""
    lines = [VERSION, *[f"{k}: {v}" for k, v in [*fields, ("Content-Length", str(len(block)))]]]
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def inflated(f, size: int = 1 << 16) -> Iterator[bytes | None]:
    """Pieces of each member's content; None at each member's end. Raises ValueError on a member that breaks off."""
    inflate, begun = zlib.decompressobj(31), False
    while data := f.read(size):
        while data:
            begun = True
            if piece := inflate.decompress(data, 1 << 20):
                yield piece
            data = inflate.unconsumed_tail or inflate.unused_data
            if inflate.eof:
                yield None
                data, inflate, begun = inflate.unused_data, zlib.decompressobj(31), False
    if begun:
        raise ValueError("the last member breaks off")


def read_records(f) -> Iterator[tuple[dict[str, str], int, str]]:
    """(header fields in lower case, payload length, payload SHA-256) of each record; raises ValueError where length, framing or a digest is wrong.

    The payload of an HTTP block is what follows its own header; another block's is the whole block.
    """
    head, fields, left, state = b"", None, 0, "header"
    block = payload = None
    http, n, tail = b"", 0, b""
    for piece in inflated(f):
        if piece is None:
            if fields is None or left or tail != b"\r\n\r\n":
                raise ValueError("a record and its member don't end together")
            if "http" in fields.get("content-type", "") and state != "payload":
                raise ValueError("an HTTP block without a header")
            for name, digest in (("warc-block-digest", block), ("warc-payload-digest", payload)):
                if name in fields and not (name == "warc-payload-digest" and fields["warc-type"] == "revisit") and fields[name] != f"sha256:{digest.hexdigest()}":
                    raise ValueError(f"{name} is wrong")
            yield fields, n, payload.hexdigest()
            head, fields, state, http, tail, n = b"", None, "header", b"", b"", 0
            continue
        if fields is None:
            head += piece
            if b"\r\n\r\n" not in head:
                continue
            top, piece = head.split(b"\r\n\r\n", 1)
            first, *lines = top.decode().split("\r\n")
            if first != VERSION:
                raise ValueError("not a WARC record")
            fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
            left, block, payload = int(fields["content-length"]), hashlib.sha256(), hashlib.sha256()
            state = "http" if "http" in fields.get("content-type", "") else "payload"
        body, tail, left = piece[:left], tail + piece[left:], max(0, left - len(piece))
        block.update(body)
        if state == "http":
            http += body
            if b"\r\n\r\n" not in http:
                continue
            body, state = http.split(b"\r\n\r\n", 1)[1], "payload"
        payload.update(body)
        n += len(body)


def page_record(page_id: int | None, url: str | None, html: bytes, kind: str, refers_to: int | None) -> bytes:
    """The record of one page; a revisit keeps the HTTP header, digest and length, not the payload."""
    name = lambda i: f"<urn:page:{i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + html
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c for c in url if c.isprintable()).encode("ascii", "backslashreplace").decode()))
    fields += [("Content-Type", "application/http;msgtype=response"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(html).hexdigest()}"), ("Payload-Length", str(len(html)))]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
    return record(fields, block)


def write_archives(pages: DataFrame, bytes_per_file: int = 256 << 20, path: str | None = None) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) and returns the manifest (path, store, n_records).

    Of rows with equal payloads of at least 100 bytes the one with the smallest page_id is the response, the others revisit it; a
    repeated page_id and payload makes a revisit of its own id only if another row is the response, so of equal rows all with the smallest
    id are responses. html null: an empty payload; page_id null: never referred to, and a revisit if another row has its payload.
    Other columns are ignored. Digests meet in an aggregation that is partial in each task. Pages without a copy are written where they are read; those that may have one
    go through a join with the digests that have, dealt over ``SALTS`` parts each.
    """
    spark = pages.sparkSession
    folder = path or shared_dir(spark, "warc")
    src = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    digest, long_enough = F.sha2(F.col("html").cast("binary"), 256), F.octet_length("html") >= LEAST_REVISIT
    first = src.where(long_enough).select(digest.alias("digest"), "page_id").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    first = written(first, "copied")
    bitmap, told = marks(first, "digest"), src.withColumn("digest", F.when(long_enough, digest))
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copied = maybe_marked(told, bitmap, "digest").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    refers = F.expr("CASE WHEN first IS NULL OR page_id <=> first THEN NULL ELSE first END")
    copied = copied.select("page_id", "url", "html", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, size, n = None, "", 0, 0

        def closed():
            out.close()
            return pa.record_batch({"path": [name], "store": ["file:///" if store.type_name == "local" else folder], "n_records": [n]})

        for batch in slices(batches, "html"):
            for row in batch.to_pylist():
                if out is not None and size > bytes_per_file:
                    yield closed()
                    out = None
                if out is None:
                    name, size, n = f"{root}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)
                data = page_record(row["page_id"], row["url"], row["html"].encode(), "response" if row["refers_to"] is None else "revisit", row["refers_to"])
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            yield closed()

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return write(pa.RecordBatch.from_arrays([*b.columns[:3], pa.nulls(b.num_rows, pa.int64())], ["page_id", "url", "html", "refers_to"]) for b in batches)

    return written(copied.mapInArrow(write, MANIFEST).unionAll(map_marked(told, alone, MANIFEST, bitmap, False, "digest")), "warc-manifest")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record, read from the archives in order; every digest and length is checked on the way, and every revisit against its response: ValueError where there is none of that id, length and digest."""

    def page(name: str | None) -> int | None:
        number = name.removeprefix("<urn:page:").removesuffix(">") if name else "None"
        return None if number == "None" else int(number)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = pafs.FileSystem.from_uri(row["store"])
                rows = []
                with store.open_input_stream(row["path"], compression=None) as f:
                    for fields, n, sha in read_records(f):
                        revisit = fields["warc-type"] == "revisit"
                        rows.append((page(fields["warc-record-id"]), int(fields["payload-length"]) if revisit else n, fields["warc-payload-digest"].removeprefix("sha256:") if revisit else sha, fields["warc-type"], page(fields.get("warc-refers-to"))))
                if len(rows) != row["n_records"]:
                    raise ValueError(f"{row['path']} has {len(rows)} of {row['n_records']} records")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    records = written(manifest.repartition(max(1, min(10_000, manifest.count())), "path").mapInArrow(read, READ), "records")
    claims = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest", "payload_bytes").distinct()
    responses = records.where("record_type = 'response'").select("page_id", "payload_digest", "payload_bytes").distinct()
    if wrong := claims.join(responses, claims.columns, "left_anti").head(1):
        raise ValueError(f"a revisit of page {wrong[0]['page_id']} has no response of its length and digest")
    return records
