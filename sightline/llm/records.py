"""Token-ID output: length-delimited binary records with masked checksums and a separate offset index.

A shard holds the token sequences of one range of document ids, ascending. Each record is

    uint64 length | uint32 masked crc of the length | payload | uint32 masked crc of the payload

with a CRC-32 masked as ((crc >> 15 | crc << 17) + 0xa282ead8) mod 2**32, all little-endian. A payload
is the ids as little-endian uint16 (vocabularies of at most 65536 ids) or uint32. The index beside
it lists every record's document id, offset and length, so that readers can shuffle records.

Shards are named at random and listed in a manifest that Spark commits: what a lost or repeated task
wrote is never listed, so never read.

Cases: null text counts as empty; an empty text is a record of the end id alone; a null document id
is allowed (first in order); repeated ids and rows are records each, in the order of their texts'
digests; other columns are ignored; an empty table gives an empty manifest.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store, tokens

INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("offset", "<u8"), ("length", "<u4")])
MANIFEST = "shard long, path string, width int, n_docs long, n_tokens long, n_bytes long"
#: Bytes of records read at a time.
READ_BYTES = 8_000_000
_MASK = 0xA282EAD8


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = len(payload).to_bytes(8, "little")
    return b"".join((size, masked_crc(size).to_bytes(4, "little"), payload, masked_crc(payload).to_bytes(4, "little")))


def unframe(data: bytes, at: int) -> bytes:
    """The payload of the record at an offset; raises ValueError if a checksum differs."""
    size = data[at : at + 8]
    end = at + 12 + int.from_bytes(size, "little")
    payload = data[at + 12 : end]
    if masked_crc(size) != int.from_bytes(data[at + 8 : at + 12], "little") or masked_crc(payload) != int.from_bytes(data[end : end + 4], "little"):
        raise ValueError(f"damaged record at {at}")
    return payload


def write_token_records(docs: DataFrame, tokenizer: str, end_id: int, folder: str, width: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` and write shards below ``folder``; returns the committed manifest."""
    spark = docs.sparkSession
    store_type = np.dtype(f"<u{width}")

    def write(batches):
        encode = tokens.encoder(tokenizer)
        shard = TaskContext.get().partitionId()
        name, out, index, at, n = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}", None, [], 0, 0
        for (ids,), texts in tokens.text_slices(batches, [key], text):
            flat, ends = encode.encode(texts)
            if len(flat) and int(flat.max()) >= 1 << 8 * width:
                raise ValueError("ids need a larger width")
            if out is None:
                fs, path = store.filesystem(name)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(f"{path}.rec")
            flat, end, frames = flat.astype(store_type), np.array([end_id], store_type).tobytes(), []
            rows = np.zeros(len(texts), INDEX)
            rows["doc_id"], rows["known"] = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                frames.append(frame(flat[a:b].tobytes() + end))
                rows[i]["offset"], rows[i]["length"] = at, b - a + 1
                at += len(frames[-1])
            out.write(b"".join(frames))
            index.append(rows)
            n += int(ends[-1]) + len(texts)
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{path}.idx") as f:
                f.write((rows := np.concatenate(index)).tobytes())
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"shard": [shard], "path": [name], "width": [width], "n_docs": [len(rows)], "n_tokens": [n], "n_bytes": [at]}).astype({"width": "int32"}))

    order = F.col(key).asc_nulls_first()
    # Rows of one id stay in one shard; their digests order them there.
    ranged = docs.select(key, text).repartitionByRange(order).sortWithinPartitions(order, F.xxhash64(F.coalesce(text, F.lit(""))))
    ranged.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_records(manifest: DataFrame, columns: str, of) -> DataFrame:
    """Rows of every shard in the manifest; ``of(rows, sequences, row)`` makes a pandas frame of a block of records.

    rows: the block's part of the index; sequences: its arrays of ids; row: the shard's manifest row.
    """

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = store.filesystem(row["path"])
                with fs.open_input_stream(f"{path}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                stops = np.append(index["offset"][1:], row["n_bytes"]).astype(np.int64)
                with fs.open_input_file(f"{path}.rec") as f:
                    at = 0
                    while at < len(index):
                        base = int(index["offset"][at])
                        to = max(at + 1, int(np.searchsorted(stops, base + READ_BYTES, "right")))
                        data = f.read_at(int(stops[to - 1]) - base, base)
                        found = [np.frombuffer(unframe(data, int(o) - base), f"<u{row['width']}") for o in index["offset"][at:to]]
                        yield pa.RecordBatch.from_pandas(of(index[at:to], found, row), preserve_index=False)
                        at = to

    n = max(1, manifest.count())
    return manifest.repartition(n, "shard").mapInArrow(read, columns)


def _digests(rows: np.ndarray, found: list[np.ndarray], row: dict) -> pd.DataFrame:
    before = row.setdefault("read", 0)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    row["read"] += int(sizes.sum())
    return pd.DataFrame({
        "shard": row["shard"], "doc_id": pd.array(np.where(rows["known"], rows["doc_id"], 0), "Int64").copy() if rows["known"].all() else pd.array([int(x) if k else None for x, k in zip(rows["doc_id"], rows["known"])], "Int64"),
        "in_shard": before + np.cumsum(sizes) - sizes, "n_tokens": sizes,
        "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in found],
    })


def token_record_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record, from the files. start counts the ids of all records before it."""
    rows = read_token_records(manifest, "shard long, doc_id long, in_shard long, n_tokens long, ids_crc32 long", _digests)
    # One row per shard: the sums run over as many rows as the write had tasks.
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")
