"""Removal of word passages that an earlier document has, by suffix automata of reference shards.

A window is ``length`` consecutive words. A word goes if a window that covers it also starts in a
document with a smaller id. Every document is reference and is streamed, but sending every shard's
automaton to every document would cost the square of the corpus, so documents meet only shards that
can hold their windows:

1. Each window names an anchor, the place of its smallest hashed gram, and windows beside each other
   with the same anchor form a run (as in ``suffixes``). Equal windows have equal grams, so only runs
   whose gram occurs in two documents go on, and of runs with equal words only the first one.
2. A run whose gram has no other words around it goes on whole. All others are taken apart into windows,
   and of those that occur in two documents the first one goes on, so that the many contexts of a common
   passage end here. What goes on belongs to the shard of the place where its gram, or its window, occurs
   first, so no shard grows with the number of copies. Windows beside each other in a text that have the
   same shard are sent as one piece.
3. A shard's pieces make a generalised suffix automaton; each state carries the smallest document id
   in which its strings end. Pieces are streamed through it: after each word the state of the longest
   match, cut to ``length`` words, tells the first document of the window that ends there.
4. Those ids go back to the windows and to all runs with the same words; spans with a smaller id than the
   run's document are merged and cut.

Words are 64-bit digests inside; equal runs are told by two of them, and the automaton compares word
by word. A run cut by the segments of a very long text is only a shorter run.

Cases: null text has no words; texts under ``length`` words keep everything; rows with the same id
don't cut each other, whatever their texts; documents with a null id neither lose words nor make
others lose any; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .suffixes import SEGMENT, _hashed, _names, _texts_of, _with, keyed, runs_of, segments

#: Words of the pieces of a shard, on average.
SHARD_WORDS = 100_000
#: Windows of a reference document that share a shard.
BLOCK = 256
#: Words of an anchor.
GRAM = 16

_RUNS = "gram long, run long, doc long, mark long, first long, size long"
_APART = "one long, two long, gram long, run long, at long, doc long, mark long, first long, last long"
_PIECES = "shard long, doc long, words binary, contents binary"
_SPANS = "gram long, run long, at long, n long, least long"


def _int64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _runs(length: int, gram: int):
    """Runs of all windows of the texts."""

    def run(batches):
        for batch in batches:
            ids, marks, texts = batch.column(0), batch.column(1), _texts_of(batch.column(2), True)
            for held, owner, place in segments(texts, length):
                h, left, starts = _hashed(held)
                first, last, anchor = runs_of(h, left, length, gram)
                if not len(first):
                    continue
                part = np.searchsorted(starts, first, "right") - 1
                who = pa.array(owner[part])
                columns = [_int64(h.window(anchor, gram)), _int64(h.window(first, last - first + length, 1)), ids.take(who), marks.take(who), pa.array(first - starts[part] + place[part]), pa.array(last - first + 1)]
                yield pa.RecordBatch.from_arrays(columns, names=_names(_RUNS))

    return run


def _windows(length: int):
    """The windows of given runs of texts, with two digests each."""

    def run(batches):
        for batch in batches:
            ids, marks, texts = batch.column(0), batch.column(1), _texts_of(batch.column(2), True)
            for i, (words, runs) in enumerate(zip(texts, batch.column(3).to_pylist())):
                gram, key, first, size, last = (np.array([r[c] for r in runs], np.int64) for c in ("gram", "run", "first", "size", "last"))
                which = np.repeat(np.arange(len(runs)), size)
                at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
                place = first[which] + at
                for base in range(0, len(words), SEGMENT):
                    here = np.flatnonzero((place >= base) & (place < base + SEGMENT))
                    if not len(here):
                        continue
                    h, _, _ = _hashed([words[base : base + SEGMENT + length - 1]])
                    here_place, mine, who = place[here] - base, which[here], pa.array(np.full(len(here), i))
                    columns = [_int64(h.window(here_place, length)), _int64(h.window(here_place, length, 1)), *map(pa.array, (gram[mine], key[mine], at[here])), ids.take(who), marks.take(who), pa.array(place[here]), pa.array(last[mine])]
                    yield pa.RecordBatch.from_arrays(columns, names=_names(_APART))

    return run


def _origin() -> Column:
    """The shard of what occurs first at ``at``, before it is divided by their number."""
    return F.xxhash64("at.doc", "at.mark", F.floor(F.col("at.first") / BLOCK)).alias("origin")


def _pieces(length: int, shards: int):
    """Words of the given runs of texts; runs beside each other in the same shard are one piece."""

    def run(batches):
        for batch in batches:
            ids, texts, out = batch.column(0), _texts_of(batch.column(2), True), []
            for i, (words, runs) in enumerate(zip(texts, batch.column(3).to_pylist())):
                of = lambda r: r["origin"] % shards
                runs.sort(key=lambda r: (r["first"], -r["size"]))
                a = 0
                while a < len(runs):
                    b, end = a + 1, runs[a]["first"] + runs[a]["size"]
                    while b < len(runs) and of(runs[b]) == of(runs[a]) and runs[b]["first"] == end:
                        end += runs[b]["size"]
                        b += 1
                    contents = np.array([(r["gram"], r["run"], r["size"]) for r in runs[a:b]], np.int64)
                    out.append((of(runs[a]), ids[i].as_py(), words[runs[a]["first"] : end + length - 1].tobytes(), contents.tobytes()))
                    a = b
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=_names(_PIECES))

    return run


class SuffixAutomaton:
    """All strings of some sequences of words; each state knows the smallest id of a sequence in which its strings end."""

    def __init__(self, sequences: list[list[int]], ids: list[int]):
        self.next, self.link, self.length, self.least = [{}], [-1], [0], [None]
        for words, who in zip(sequences, ids):
            last = 0
            for w in words:
                last = self._extend(last, w)
                if self.least[last] is None or who < self.least[last]:
                    self.least[last] = who
        for s in np.argsort(np.array(self.length), kind="stable")[:0:-1].tolist():  # longer strings end where their suffixes do
            p, mine = self.link[s], self.least[s]
            if self.least[p] is None or (mine is not None and mine < self.least[p]):
                self.least[p] = mine

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.least.append(None)
        return len(self.length) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of the longest string of p followed by w; a copy of where that leads now, if there are longer ones."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def first_of_windows(self, words: list[int], length: int) -> list[int | None]:
        """For each window of ``length`` words the smallest id of a sequence that has it, or None: matching statistics cut to ``length``."""
        state, matched, out = 0, 0, []
        nxt, link, size = self.next, self.link, self.length
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                matched = size[state]
            if w in nxt[state]:
                state, matched = nxt[state][w], matched + 1
            while state and size[link[state]] >= length:
                state = link[state]
            matched = min(matched, size[state])
            if i >= length - 1:
                out.append(self.least[state] if matched >= length else None)
        return out


def _stream(length: int):
    """Rows of ``_SPANS`` for the contents of the shards in a partition, which arrive in the order of shards."""

    def matched(rows: list[tuple]):
        ids, words = [r[0] for r in rows], [np.frombuffer(r[1], np.uint64) for r in rows]
        cuts = np.cumsum([len(x) for x in words])[:-1]
        named = np.unique(np.concatenate(words), return_inverse=True)[1]  # small numbers in the place of digests
        sequences = [x.tolist() for x in np.split(named, cuts)]
        automaton = SuffixAutomaton(sequences, ids)
        for sequence, (_, _, contents) in zip(sequences, rows):
            least, base = np.array(automaton.first_of_windows(sequence, length)), 0
            for gram, run, size in np.frombuffer(contents, np.int64).reshape(-1, 3).tolist():
                mine = least[base : base + size]
                new = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                for at, n in zip(new.tolist(), np.diff(np.r_[new, size]).tolist()):
                    yield gram, run, at, n, int(mine[at])
                base += size

    def batch_of(rows):
        columns = list(zip(*rows)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_names(_SPANS))

    def run(batches):
        shard, held = None, []
        for batch in batches:
            for now, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if now != shard and held:
                    yield batch_of([*matched(held)])
                    held = []
                shard = now
                held.append(tuple(row))
        if held:
            yield batch_of([*matched(held)])

    return run


def earlier_spans(rows: DataFrame, length: int = 50) -> DataFrame:
    """(doc, mark, spans) of texts with words to remove; spans: array of (first, size) in words. rows: doc, mark, text."""
    if length <= GRAM:
        raise ValueError("length is too small")
    known = rows.where(F.col("doc").isNotNull() & (F.octet_length("text") >= 2 * length - 1))
    runs = known.mapInArrow(_runs(length, GRAM), _RUNS)
    grams = runs.groupBy("gram").agg(F.min(F.struct("doc", "mark", "first")).alias("at"), F.max("doc").alias("last")).where("at.doc < last")
    flagged = store.materialise(runs.join(grams.select("gram", _origin()), "gram"), "runs")
    contents = flagged.groupBy("gram", "run", "origin").agg(F.min(F.struct("doc", "mark", "first", "size")).alias("at"), F.max("doc").alias("last")).select("gram", "run", "origin", "at.*", "last")
    contents = store.materialise(contents, "contents")
    several = contents.groupBy("gram").count()
    counted = contents.join(several, "gram")
    by_doc = counted.where("count > 1").groupBy("doc", "mark").agg(F.collect_set(F.struct("gram", "run", "first", "size", "last")).alias("runs"))
    apart = store.materialise(_with(known, by_doc, "runs").mapInArrow(_windows(length), _APART), "windows")
    firsts = apart.groupBy("one", "two").agg(F.min(F.struct("doc", "mark", "first")).alias("at"), F.max("last").alias("last")).where("at.doc < last")
    windows = firsts.select(F.col("one").alias("gram"), F.col("two").alias("run"), _origin(), "at.*", F.lit(1).cast("long").alias("size"))
    going = store.materialise(counted.where("count = 1").select("gram", "run", "origin", "doc", "mark", "first", "size").unionByName(windows), "going")
    n_words = going.agg(F.sum(F.col("size") + length // 4)).first()[0] or 0
    wanted = going.groupBy("doc", "mark").agg(F.collect_set(F.struct("first", "size", "gram", "run", "origin")).alias("runs"))
    pieces = _with(known, wanted, "runs").mapInArrow(_pieces(length, 1 + n_words // SHARD_WORDS), _PIECES)
    # Rows equal in id and text were each a piece.
    found = store.materialise(pieces.repartition("shard").sortWithinPartitions("shard").mapInArrow(_stream(length), _SPANS).distinct(), "firsts")
    back = apart.join(found.select(F.col("gram").alias("one"), F.col("run").alias("two"), "least"), ["one", "two"]).select("gram", "run", "at", F.lit(1).cast("long").alias("n"), "least")
    spans = found.unionByName(back).groupBy("gram", "run").agg(F.collect_set(F.struct("at", "n", "least")).alias("spans"))
    earlier = F.filter("spans", lambda s: s["least"] < F.col("doc"))
    placed = F.transform(earlier, lambda s: F.struct((F.col("first") + s["at"]).alias("first"), (s["n"] + (length - 1)).alias("size")))
    met = flagged.join(spans, ["gram", "run"]).select("doc", "mark", placed.alias("spans")).where("size(spans) > 0")
    return met.groupBy("doc", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _cut(with_text: bool):
    """What is left of texts of which the spans go."""

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0), []
            for text, spans in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist()):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int64)
                for s in spans or ():
                    gone[s["first"]] += 1
                    gone[s["first"] + s["size"]] -= 1
                kept = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g] if spans else words
                left = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), left.decode() if with_text else hashlib.sha256(left).hexdigest()))
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))]], names=["doc_id", "n_words", "n_removed", "text" if with_text else "kept_sha256"])

    return run


def remove_earlier(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and text of every row: its words that no earlier document has in a window, joined by one space.

    digest: kept_sha256 of that text in the place of it.
    """
    rows = keyed(docs, key, text)
    spans = store.materialise(earlier_spans(rows, length), "spans").select(F.col("doc").alias("other_doc"), F.col("mark").alias("other_mark"), "spans")
    whole = rows.join(spans, (F.col("doc") == F.col("other_doc")) & (F.col("mark") == F.col("other_mark")), "left").select("doc", "text", "spans")
    return whole.mapInArrow(_cut(not digest), f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'text'} string")
