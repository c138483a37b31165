"""Token counts through a digest cache.

A document's key is the digest of its normalised content with the digest of the tokenizer file, so a
new tokenizer version never meets old counts. Distinct keys that the cache lacks are encoded once
and appended to it; counts then join back to documents by key.

Normalising must not change a count: runs of ASCII white space become one space and the ends are
trimmed, which only suits tokenizers that drop white space (``drops_space``); for others the content
stays as it is.

Cases: null text counts as empty (0 tokens, 0 bytes); repeated rows each get their row; null ids are
kept; other columns are ignored; an empty table leaves the cache as it is. The cache may hold a key
twice after two runs at a time; both rows are equal and are read as one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, tokens

CACHE = "digest binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text: Column, drops_space: bool) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")) if drops_space else text


def read_cache(spark: SparkSession, folder: str, version: str) -> DataFrame:
    rows = spark.read.schema(CACHE).parquet(folder)
    return rows.where(F.col("tokenizer") == version).dropDuplicates(["digest"]).select("digest", "n_tokens")


def create_cache(spark: SparkSession, folder: str) -> None:
    spark.createDataFrame([], CACHE).write.mode("ignore").parquet(folder)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, drops_space: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row; counts missing from the cache folder are appended to it."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    create_cache(spark, cache)
    content = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), normalised(F.col(text), drops_space).alias("content"))
    content = content.withColumn("digest", F.unhex(F.sha2("content", 256)))

    def encode(batches):
        counter = tokens.encoder(tokenizer, keep_space=not drops_space)
        for (digests,), texts in tokens.text_slices(batches, ["digest"], "content"):
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays([digests.cast(pa.binary()), pa.array([version] * len(n), pa.string()), pa.array(n.astype(np.int64))], names=["digest", "tokenizer", "n_tokens"])

    # The map side keeps one text for each key, so a text with many copies isn't moved many times.
    distinct = content.groupBy("digest").agg(F.first("content").alias("content"))
    misses = distinct.join(read_cache(spark, cache, version), "digest", "left_anti")
    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    # A table on both sides lets adaptive execution split a digest that very many documents share.
    counts = store.materialise(read_cache(spark, cache, version), "token-counts")
    return content.select("doc_id", "n_bytes", "digest").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
