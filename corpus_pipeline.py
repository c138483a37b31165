"""From raw documents to training sequences: every stage works on all that the one before it kept.

documents has doc_id, text and any other columns, which all stages but the last carry along unchanged
(suffix_dedup counts n_chars anew). An empty table gives an empty table at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import decontaminate, packing, quality, simhash, store, suffixes

#: A document goes if its text is less likely of good quality than this.
LEAST_QUALITY = 0.5
SHINGLE = 5
#: Words of the shortest passage that goes if it also starts elsewhere.
PASSAGE = 51
END_ID, CAPACITY = 1, 2048


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, fitted on the labels, rejects.

    Null and empty texts are scored like others; long texts are scored whole; repeated rows score alike
    and stay or go together; null ids stay if their text does. Columns keep their names and values.
    """
    net = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, net, LEAST_QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest id, of each group of near copies.

    Null, empty and blank texts are copies of each other. Texts under SHINGLE words are one shingle. Rows
    equal in id and text are one document; different texts with one id are different documents, and where
    they tie for the smallest id the one with the smallest digest stays. Rows with a null id stay. Other
    columns are those of the row kept.
    """
    return simhash.keep_one(docs, SHINGLE)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut runs of PASSAGE words and strings of 400 bytes that also start elsewhere; texts of which nothing is left go.

    Null and shorter texts stay as they are; of repeated rows each is the other's elsewhere, so long ones
    go; null ids are cut and kept like others. A character that a cut falls into goes. Other columns stay.
    """
    # Own columns travel in one, whatever they are named.
    rows = docs.select(F.struct("*").alias("whole"), F.col("doc_id").alias("row_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_mark"))
    cut = store.materialise(suffixes.remove_repeats(docs.select("doc_id", "text"), with_mark=True, decode=True, n_words=PASSAGE).select(F.col("doc_id").alias("cut_id"), F.col("mark").alias("cut_mark"), F.col("text").alias("left_over")).distinct(), "cut")
    joined = rows.join(cut, F.col("row_id").eqNullSafe(F.col("cut_id")) & (F.col("row_mark") == F.col("cut_mark")), "left")
    changed, left = F.col("left_over").isNotNull(), F.col("left_over")
    kept = joined.where(~changed | (F.trim(left) != ""))
    new = {"text": left, "n_chars": F.char_length(left).cast("long")}
    return kept.select(*[(F.when(changed, new[c]).otherwise(F.col("whole")[c]) if c in new else F.col("whole")[c]).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item.

    Null and empty texts hold none; repeated rows stay or go together; null ids are judged like others;
    an empty benchmark drops nothing. Columns keep their names and values.
    """
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most CAPACITY.

    A null text counts as empty and has its end id; every row is a document, repeated or not; null ids
    are kept; long texts are cut into pieces; other columns are left out.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, CAPACITY)


STAGES = [("quality classifier", quality_filter), ("SimHash near-dedup", near_dedup), ("suffix-array dedup", suffix_dedup), ("benchmark decontamination", decontamination), ("packing", pack)]
#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
