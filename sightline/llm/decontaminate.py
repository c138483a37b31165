"""Benchmark decontamination: exact containment of item windows in documents, as a prefix-filtered set join.

Words are lower-cased (A-Z only) runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. A window is ``window``
consecutive words of an item, or a whole shorter item. For containment of a whole window its prefix
is one word: the rarest by its count in all documents. Each document word that is such a prefix is a
candidate; the word's place in the window bounds where the window would start and end in the
document, and the words there must equal the window.

Counting is a first pass over the documents and joining a second; both stay in DataFrame functions.
The words to look for are a literal set of at most BLOCK_WORDS words, and larger benchmarks take more
passes with a block of words each, so that neither the set nor the broadcast windows grow without
bound. What belongs to one document is found in its own row and task, so nothing is shuffled by text.
Rows are numbered by their place in the input, so where more blocks than one are needed the input must
have the same partitions in each pass, as a table has.

Cases: null or empty texts and items have no words; items without words are no items; repeated items
and ids count as the item ids they carry (a null item id is not listed in items but its words are
hit); repeated documents are rows each; null document ids are kept; other columns are ignored; an
empty table on either side gives no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

BLOCK_WORDS = 50_000
#: Windows that are broadcast, at most; beyond, the candidates are shuffled by their prefix.
BLOCK_WINDOWS = 200_000
#: Runs of word characters before lower-casing: A-Z are word characters too.
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORDS), F.lit(0))


def windows_of(items: DataFrame, window: int, key: str, text: str) -> DataFrame:
    """Distinct (item_id, words) of every window of every item."""
    words = items.select(F.col(key).alias("item_id"), words_of(F.col(text)).alias("all")).where("size(all) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("all", i, window))).alias("words")).distinct()


def word_counts(docs: DataFrame, vocabulary: list[str], text: str = "text") -> DataFrame:
    """How often the documents hold each word of the vocabulary."""
    found = F.filter(words_of(F.col(text)), lambda w: w.isin(vocabulary))
    return docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def with_prefixes(windows: DataFrame, counts: DataFrame, few: bool) -> DataFrame:
    """Adds each window's rarest word and its first place there (from 0). few: the counts are of BLOCK_WORDS at most."""
    counts = F.broadcast(counts) if few else counts
    placed = windows.select("item_id", "words", F.posexplode("words").alias("place", "word")).join(counts, "word", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("r")
    return placed.groupBy("item_id", "words").agg(rarest).where("r.n > 0").select("item_id", "words", F.col("r.word").alias("prefix"), F.col("r.place").alias("place"))


def _candidates(docs: DataFrame, prefixes: list[str], window: int, key: str, text: str) -> DataFrame:
    """A row for each word of a document that is a prefix, with the words around it; one with nulls if there is none."""
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), words_of(F.col(text)).alias("words"))
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(prefixes), i).otherwise(-1)), lambda i: i >= 0)
    first = lambda i: F.greatest(i - (window - 1), F.lit(0))
    around = F.transform(places, lambda i: F.struct(i.alias("at"), first(i).alias("first"), F.element_at("words", i + 1).alias("prefix"), F.slice("words", first(i) + 1, 2 * window - 1).alias("near")))
    return found.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.explode_outer(around).alias("c")).select("row", "doc_id", "n_words", "c.*")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, item_ids (sorted strings of the items with windows in it)."""
    windows = store.materialise(windows_of(items, window, item_key, item_text), "windows")
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    counts, few = None, vocabulary.count() <= BLOCK_WORDS
    for block in _blocks(vocabulary, "word"):
        part = word_counts(docs, block, text)
        counts = part if counts is None else counts.unionByName(part)
    if counts is None:
        counts = vocabulary.select("word", F.lit(0).cast("long").alias("n"))
    ready = store.materialise(with_prefixes(windows, counts, few), "prefixes")
    hits, small = None, ready.count() <= BLOCK_WINDOWS
    for block in _blocks(ready.select(F.col("prefix").alias("word")).distinct(), "word"):
        wanted = ready.where(F.col("prefix").isin(block))
        if small:
            wanted = F.broadcast(wanted)
        part = _verified(_candidates(docs, block, window, key, text), wanted)
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = _verified(_candidates(docs, [], window, key, text), ready)
    return hits.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.size(F.array_distinct(F.flatten(F.collect_set("hit")))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
    ).drop("row")


def _blocks(words: DataFrame, column: str):
    """The distinct words in lists of about BLOCK_WORDS."""
    n = -(-words.count() // BLOCK_WORDS)
    for i in range(n):
        part = words if n == 1 else words.where(F.pmod(F.xxhash64(column), F.lit(n)) == i)
        yield [r[0] for r in part.collect()]


def _verified(candidates: DataFrame, windows: DataFrame) -> DataFrame:
    """Places hit and item of each candidate whose window is there; documents without one keep a row of nulls."""
    length, start = F.size("words"), F.col("at") - F.col("place")
    joined = candidates.join(windows.withColumnRenamed("prefix", "window_prefix"), F.col("prefix") == F.col("window_prefix"), "left")
    inside = (start >= F.col("first")) & (start + length <= F.col("n_words"))
    hit = inside & (F.slice("near", F.greatest(start - F.col("first"), F.lit(0)) + 1, F.greatest(length, F.lit(1))) == F.col("words"))
    return joined.select("row", "doc_id", "n_words", F.when(hit, F.sequence(start, start + length - 1)).alias("hit"), F.when(hit, F.col("item_id").cast("string")).alias("item_id"))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that hold a window of an item."""
    mark = F.xxhash64(F.coalesce(text, F.lit("")))
    found = contamination(docs.select(F.struct(F.col(key).alias("id"), mark.alias("mark")).alias("who"), text), items, window, "who", text)
    dirty = found.where("n_hit > 0").select("doc_id.id", "doc_id.mark").distinct()
    return docs.join(dirty, docs[key].eqNullSafe(dirty["id"]) & (mark == dirty["mark"]), "left_anti")
