"""Ranked lexical search: the best documents of each item, by range-maximum tables over posting lists.

Terms are maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased. One pass over
the documents keeps, of each, its number of terms and the items' terms in it; from that come the counts
of the whole table and each term's weight. Then every task indexes its documents a shard at a time:

* A term's posting list holds documents and impacts, with a sparse table of the place of the largest
  impact in every stretch of two to the power of n postings, so that the largest of any stretch is read
  from two entries.
* For an item, an interval of the shard's documents is bounded by the sum of its terms' largest weighted
  impacts there. Intervals wait in the order of their bounds. The best ones are split at the document of
  the largest impact, which is scored exactly, and both sides are bounded anew. An interval goes as soon
  as its bound is below the score that is surely needed: the k-th best of the shard so far, or of a
  sample of documents that is searched first. Bounds only order and end the work: no document that could
  be among the best is left out.

The shards' best are merged. Items are taken in blocks of about BLOCK_TERMS terms, each with a pass of
its own, so that what tasks are sent doesn't grow with the items.

Cases: null texts have no terms; documents without terms don't count; every row is a document, repeated or
not; a null document id comes first among equal scores; rows with one item id are one item with the terms
of all of them; items without terms or without any document that scores have no rows; other columns are
ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .decontaminate import words_of

#: Terms of the items in a block, about.
BLOCK_TERMS = 200_000
#: Postings and documents of a shard, at most, but for a document with more.
SHARD_POSTINGS, SHARD_DOCS = 600_000, 16_384
#: Documents searched first, about.
SAMPLE_DOCS = 8192
#: Intervals split at a time.
FRONT = 128

_BREAKS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_POSTINGS = "doc_id long, n long, terms binary, counts binary"
_FOUND = "item int, doc_id long, score long"


def _postings(vocabulary: list[str]):
    """Of each document with terms: how many it has, and which of the vocabulary how often."""
    number = {t.encode(): i for i, t in enumerate(vocabulary)}

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.large_binary()).to_pylist():
                words = (text or b"").lower().translate(_BREAKS).split()
                found = np.array([i for i in map(number.get, words) if i is not None], np.int32)
                terms, counts = np.unique(found, return_counts=True)
                rows.append((len(words), terms.tobytes(), counts.astype(np.int32).tobytes()))
            columns = list(zip(*rows)) if rows else [[]] * 3
            out = pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))]], names=["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.compute.greater(out.column(1), 0))

    return run


def _frequencies(n_terms: int):
    """How many of the documents hold each term."""

    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int32), minlength=n_terms)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], names=["term", "df"])

    return run


class Postings:
    """Posting lists of some documents, one after another, with a table of the places of largest impacts."""

    def __init__(self, n: np.ndarray, terms: list[bytes], counts: list[bytes], n_docs: int, n_all: int):
        """n: the terms of each document; n_docs and n_all: documents and terms of the whole table."""
        sizes = np.array([len(t) // 4 for t in terms])
        term, tf = np.frombuffer(b"".join(terms), np.int32), np.frombuffer(b"".join(counts), np.int32).astype(np.int64)
        doc = np.repeat(np.arange(len(n)), sizes)
        order = np.argsort(term, kind="stable")
        length = np.array([10 + (90 * x * n_docs) // n_all for x in n.tolist()], np.int64)  # may pass 64 bits on the way
        self.docs, self.term, self.doc, tf = len(n), term[order].astype(np.int64), doc[order], tf[order]
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * length[self.doc])
        self.key = self.term * self.docs + self.doc
        longest = int(np.bincount(self.term).max()) if len(self.term) else 1
        self.best = [np.arange(len(self.key), dtype=np.int32)]
        for level in range(1, longest.bit_length()):
            a, half = self.best[-1], 1 << (level - 1)
            b = a.copy()
            b[:-half] = np.where(self.impact[a[half:]] > self.impact[a[:-half]], a[half:], a[:-half])
            self.best.append(b)
        self.best = np.stack(self.best) if len(self.key) else np.zeros((1, 1), np.int32)

    def largest(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the largest impact, that impact or 0) of stretches of postings."""
        size = high - low
        full = size > 0
        level = np.frexp(np.maximum(size, 1))[1] - 1
        a = self.best[level, np.where(full, low, 0)]
        b = self.best[level, np.where(full, high - (1 << level), 0)]
        at = np.where(self.impact[b] > self.impact[a], b, a)
        return at, np.where(full, self.impact[at], 0)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, needed: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that hold the k best by score, and all that tie with the last of them; at least ``needed`` each."""
        base = (terms * self.docs)[:, None]
        low, high = np.searchsorted(self.key, base), np.searchsorted(self.key, base + self.docs)
        some = (low < high)[:, 0]
        base, low, high, weights = base[some], low[some], high[some], weights[some][:, None]
        docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not len(base):
            return docs[0], scores[0]
        at, impact = self.largest(low, high)
        bound, top = (impact * weights).sum(0), np.zeros(0, np.int64)
        while True:
            wanted = np.flatnonzero(bound >= needed)
            if not len(wanted):
                return np.concatenate(docs), np.concatenate(scores)
            if len(wanted) > FRONT:
                first = np.argpartition(-bound[wanted], FRONT)
                now, later = wanted[first[:FRONT]], wanted[first[FRONT:]]
            else:
                now, later = wanted, wanted[:0]
            mine = at[:, now]
            part = self.impact[mine] * weights * (high[:, now] > low[:, now])
            cut = self.doc[mine[part.argmax(0), np.arange(len(now))]]
            place = np.searchsorted(self.key, base + cut)
            hit = self.key[np.minimum(place, len(self.key) - 1)] == base + cut
            score = (np.where(hit, self.impact[np.minimum(place, len(self.key) - 1)], 0) * weights).sum(0)
            docs.append(cut)
            scores.append(score)
            top = np.sort(np.concatenate([top, score]))[-k:]
            if len(top) == k:
                needed = max(needed, int(top[0]))
            new_low, new_high = np.concatenate([low[:, now], place + hit], 1), np.concatenate([place, high[:, now]], 1)
            new_at, new_impact = self.largest(new_low, new_high)
            low, high = np.concatenate([low[:, later], new_low], 1), np.concatenate([high[:, later], new_high], 1)
            at, bound = np.concatenate([at[:, later], new_at], 1), np.concatenate([bound[later], (new_impact * weights).sum(0)])


def _search(queries: list[np.ndarray], weights: np.ndarray, needed: list[int], k: int, n_docs: int, n_all: int):
    """The best documents of each shard for every query."""

    def best(ids: list, n: list, terms: list, counts: list):
        index, out = Postings(np.array(n, np.int64), terms, counts, n_docs, n_all), []
        order = np.array([-(2**63) if i is None else i for i in ids], np.int64)
        for item, (mine, least) in enumerate(zip(queries, needed)):
            docs, scores = index.search(mine, weights[mine], k, max(1, least))
            for i in np.lexsort((order[docs], -scores))[:k].tolist():
                if scores[i] > 0:
                    out.append((item, ids[docs[i]], int(scores[i])))
        columns = list(zip(*out)) if out else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    def run(batches):
        held, size = [[], [], [], []], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held[0] and (size + len(row[2]) // 4 > SHARD_POSTINGS or len(held[0]) >= SHARD_DOCS):
                    yield best(*held)
                    held, size = [[], [], [], []], 0
                for column, value in zip(held, row):
                    column.append(value)
                size += len(row[2]) // 4
        if held[0]:
            yield best(*held)

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _of_block(docs: DataFrame, items: list, k: int, item_type: str) -> DataFrame:
    """item_id, doc_id and score of the best documents of the shards, for (item_id, terms) of a block."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, terms in items for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    queries = [np.array(sorted(number[t] for t in terms), np.int64) for _, terms in items]
    held = store.materialise(docs.mapInArrow(_postings(vocabulary), _POSTINGS), "postings")
    n_docs, n_all = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = held.mapInArrow(_frequencies(len(vocabulary)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    weights = np.zeros(len(vocabulary), np.int64)
    for t, n in zip(df.column("term").to_pylist(), df.column("df").to_pylist()):
        weights[t] = weight(n_docs, n)
    search = lambda rows, needed: rows.mapInArrow(_search(queries, weights, needed, k, n_docs, n_all), _FOUND)
    few = held.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, n_docs // SAMPLE_DOCS))) == 0).coalesce(8)
    last = _best(search(few, [0] * len(items)), "item", k).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == k).toArrow()
    needed = [0] * len(items)
    for item, score in zip(last.column("item").to_pylist(), last.column("score").to_pylist()):
        needed[item] = score
    names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(items)], f"item int, item_id {item_type}")
    # Names of a block's items, of which there are BLOCK_TERMS at most.
    return search(held, needed).join(F.broadcast(names), "item").select("item_id", "doc_id", "score")


def _best(found: DataFrame, item: str, k: int) -> DataFrame:
    order = Window.partitionBy(item).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k best documents."""
    rows = store.small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    terms = items.select(F.col(item_key).alias("item_id"), F.explode(words_of(F.col(item_text))).alias("term")).distinct()
    asked = store.materialise(terms.groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms")), "items")
    blocks = 1 + (asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS
    kind, found = asked.schema["item_id"].dataType.simpleString(), None
    for i in range(blocks):
        mine = [(r[0], r[1]) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect()]
        part = _of_block(rows, mine, k, kind)
        found = part if found is None else found.unionByName(part)
    return _best(found, "item_id", k).select("item_id", "rank", "doc_id", "score")
