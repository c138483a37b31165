"""WARC archives with revisit resolution.

Headers (page id, payload digest, size) are shuffled by digest to find each payload's original, the
smallest page id; then each page's resolution joins back to its payload by page id, so that a payload
with many copies never gathers in one task. Originals are written with their payload as ``response``
records, all others as ``revisit`` records that refer to the original and carry no payload. Every
record is a gzip member with fresh headers. What a lost task wrote is not in the manifest.

Cases: null html counts as empty; rows with a null page id are originals themselves (a record must
have an id to be referred to); repeated rows of the original's page id are responses each; a null url
leaves out its header; other columns are ignored; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

MANIFEST = "path string, n_records long"
HEADERS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
WRITE_BYTES, READ_BYTES = 8_000_000, 4_000_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-31T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: four groups of 40 bits, each eight digits of base 32."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve_revisits(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds refers_to, the original of a revisit, to distinct (page_id, payload_digest, payload_bytes)."""
    originals = headers.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("original"))
    found = headers.distinct().join(originals, ["payload_digest", "payload_bytes"], "left")
    return found.select("page_id", "payload_digest", "payload_bytes", F.when(F.col("page_id") > F.col("original"), F.col("original")).alias("refers_to"))


def _record(page_id, url, digest: str, payload: bytes, refers_to, refers_url=None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is None:
        lines.append("WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode())
    else:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return _member("\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n")


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write every page as a record below ``folder``; returns the committed manifest of archives."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("payload_digest", base32_sha1(F.col("html").cast("binary")))
    headers = pages.select("page_id", "payload_digest", F.octet_length("html").cast("long").alias("payload_bytes"))
    resolved = resolve_revisits(headers, least_bytes).select(F.col("page_id").alias("id"), F.col("payload_digest").alias("digest"), "refers_to").hint("merge")

    def write(batches):
        name, out, n = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            if out is None:
                fs, path = store.filesystem(name)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
                out.write(_member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload_digest", "html", "refers_to")]
            held, size = [], 0
            for page, url, digest, html, refers in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2].to_pylist(), pc.cast(columns[3], pa.large_binary()), columns[4].to_pylist()):
                held.append(_record(page, url, digest, html.as_py(), refers))
                size += len(held[-1])
                if size > WRITE_BYTES:
                    out.write(b"".join(held))
                    held, size = [], 0
            out.write(b"".join(held))
            n += len(batch)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"path": [name], "n_records": [n]}))

    joined = pages.join(resolved, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("payload_digest") == F.col("digest")))
    joined.select("page_id", "url", "payload_digest", "html", "refers_to").mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def records_of(stream):
    """(headers, payload) of each gzip member of an archive, one record in memory at a time."""
    data, z, parts = stream.read(READ_BYTES), zlib.decompressobj(31), []
    while data:
        parts.append(z.decompress(data))
        if z.eof:
            head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]
            data, z, parts = z.unused_data or stream.read(READ_BYTES), zlib.decompressobj(31), []
        else:
            data = stream.read(READ_BYTES)
    if any(parts):
        raise ValueError("an archive ends inside a record")


def read_archives(manifest: DataFrame) -> DataFrame:
    """HEADERS of every record, read from the archives; a revisit's payload_bytes are those of the response it refers to."""

    def number(field):
        value = field[len("<urn:page:") : -1] if field else ""
        return int(value) if value else None

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = store.filesystem(name)
                rows = []
                with fs.open_input_stream(path, compression=None) as f:
                    for fields, payload in records_of(f):
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"damaged record {fields['WARC-Record-ID']} in {name}")
                        rows.append((number(fields["WARC-Record-ID"]), len(payload), digest, kind, number(fields.get("WARC-Refers-To"))))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in HEADERS.split(", ")])

    rows = manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(read, HEADERS)
    full = rows.where("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("refers_to"), F.col("payload_digest"), F.col("payload_bytes").alias("full_bytes")).distinct().hint("merge")  # as many as pages: never broadcast
    return rows.join(full, ["refers_to", "payload_digest"], "left").select("page_id", F.coalesce("full_bytes", "payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
