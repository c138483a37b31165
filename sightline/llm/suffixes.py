"""Suffix-array removal of long repeated strings.

A place goes if a string of ``length`` covering it also starts elsewhere, in the same text or another.
Places are bytes, or words. Not every suffix is sorted. Each window of ``length`` names an anchor: the
place of the smallest hash among its strings of a shorter length (the first on ties), which depends on
the window alone, so equal windows have equal anchors at the same distance. Windows beside each other
mostly share theirs and form a run.

1. The suffixes at anchors are range-partitioned by their leading token (eight bytes, or a word), the
   digest of their anchor string and the digest of their run. The splitters are quantiles of a sample
   of documents; tasks look their rows' bucket up, so hashing runs once. Each bucket is sorted by
   multikey quicksort. An anchor alone in its group ends there. Runs with an equal run are covered.
   Where a group also has runs without one, those and one run for each equal set go on. A group at the
   edge of a bucket may go on in the next; such groups are compared across buckets.
2. The windows of the runs that go on are sorted in the same way; windows that meet an equal one are
   covered.

Ranges are also cut by document, so that a string in very many places is spread over buckets. Texts
over SEGMENT places are hashed in overlapping segments; a run cut there only is one that goes on.
Strings count as equal if their leading token and two 64-bit digests are: n strings that differ meet
such an accident with a probability of about n * n / 2**129.

Cases: null text counts as empty; texts under ``length`` keep everything; of repeated rows each
is the other's elsewhere; null ids are kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: Places hashed at a time.
SEGMENT = 300_000
#: Documents whose suffixes give the splitters, about, and the most suffixes taken of these.
SAMPLE_DOCS, SAMPLE_ROWS = 4000, 40_000
#: Bytes of text, and windows of open runs, that make one bucket more than there are shuffle partitions.
BUCKET_BYTES, BUCKET_WINDOWS = 100_000_000, 1_000_000
_U = np.uint64
_BITS = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xC2B2AE3D27D4EB4F)
#: Odd multipliers of the two prefix sums, and their inverses modulo 2**64.
_STEPS = 0x5851F42D4C957F2D, 0xD1342543DE82EF95


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _BITS[0]
    x ^= x >> _U(29)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    out[1:] = _U(base)
    return np.multiply.accumulate(out)


class Hashes:
    """Digests of the strings of any length from every place, from sums of symbols times powers."""

    _held: dict[int, np.ndarray] = {}

    def __init__(self, data: np.ndarray):
        """data: bytes, or 64-bit digests of words."""
        if data.dtype == np.uint8:  # a symbol is eight bytes, so a string of n bytes has n - 7
            self.tail, n = 7, max(0, len(data) - 7)
            self.lead = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(7, np.uint8)]), 8)[: len(data)]
            symbols = _mix(self.lead[:n].copy().view("<u8").ravel().astype(_U) + _U(1))
        else:
            self.tail, self.lead, n = 0, data, len(data)
            symbols = _mix(data + _U(1))
        self.sums = []
        for i, step in enumerate(_STEPS):
            if i:
                symbols = _mix(symbols ^ (symbols >> _U(32)))
            self.sums.append(np.concatenate([np.zeros(1, _U), np.cumsum(symbols * self._power(step, n))]))

    @classmethod
    def _power(cls, base: int, n: int) -> np.ndarray:
        if base not in cls._held or len(cls._held[base]) < n:
            cls._held[base] = _powers(base, n)
        return cls._held[base][:n]

    def leads(self, at: np.ndarray) -> np.ndarray:
        """The leading token from each place, as a word of the order of its bytes."""
        return np.ascontiguousarray(self.lead[at]).view(">u8").ravel().astype(_U) if self.tail else self.lead[at]

    def all(self, length: int) -> np.ndarray:
        """Digest of ``length`` from every place that has so many left."""
        sums, m = self.sums[0], length - self.tail
        return _mix((sums[m:] - sums[:-m]) * self._power(_inverse(_STEPS[0]), len(sums) - m)) if len(sums) > m else sums[:0]

    def window(self, at: np.ndarray, length: np.ndarray | int, which: int = 0) -> np.ndarray:
        """Digest of ``length`` from each place; ``which`` of two."""
        sums, powers = self.sums[which], self._power(_inverse(_STEPS[which]), len(self.sums[0]))
        return _mix((sums[at + (length - self.tail)] - sums[at]) * powers[at])


def _inverse(x: int) -> int:
    return pow(x, -1, 2**64)


def runs_of(h: Hashes, left: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor) of every run. left: places from each to its text's end."""
    valid = np.flatnonzero(left >= length)
    if not len(valid):
        return valid, valid, valid
    place = _U((1 << 24) - 1)
    low = h.all(gram)
    low = (low & ~place) | np.arange(len(low), dtype=_U)
    span, width = 1, length - gram + 1
    while span * 2 <= width:
        low[:-span] = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low[: span - width] = np.minimum(low[: span - width], low[width - span :])
    anchor = (low[valid] & place).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)])
    last = np.r_[first[1:], len(valid)] - 1
    return valid[first], valid[last], anchor[first]


def segments(texts: list, length: int):
    """(parts, the owner of each, its place in its text) of texts joined to about SEGMENT places."""
    held, owner, place, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), SEGMENT):
            part = text[at : at + SEGMENT + length - 1]
            if size and size + len(part) > SEGMENT:
                yield held, np.array(owner), np.array(place)
                held, owner, place, size = [], [], [], 0
            held.append(part)
            owner.append(i)
            place.append(at)
            size += len(part)
    if held:
        yield held, np.array(owner), np.array(place)


def _hashed(held: list) -> tuple[Hashes, np.ndarray, np.ndarray]:
    """(hashes, places left from each, where each part starts)."""
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(held), np.uint8) if isinstance(held[0], bytes) else np.concatenate(held)
    return Hashes(data), np.repeat(starts + sizes, sizes) - np.arange(sizes.sum()), starts


def _signed(x: np.ndarray) -> pa.Array:
    """Unsigned words as longs of the same order."""
    return pa.array((x ^ _U(1 << 63)).view(np.int64))


_KEYS = "lead long, gram long, run long, spread long"
_ANCHORS = _KEYS + ", doc long, mark long, first long, size long, bucket int"
_WINDOW_KEYS = "lead long, one long, two long, spread long"
_WINDOWS = _WINDOW_KEYS + ", doc long, mark long, first long, bucket int"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _texts_of(column: pa.Array, of_words: bool) -> list:
    """The texts, or the digests of their words."""
    data = column.cast(pa.large_binary())
    if not of_words:
        return data.to_pylist()
    from xxhash import xxh64_intdigest

    return [np.array([*map(xxh64_intdigest, x.as_py().split())], _U) for x in data]


def _spread(ids: pa.Array, marks: pa.Array, first: np.ndarray) -> np.ndarray:
    """A hash of a place in a document, which deals equal strings out."""
    x = ids.fill_null(-1).to_numpy().view(_U) * _BITS[1] + marks.to_numpy().view(_U) * _BITS[2] + first.astype(_U)
    return _mix(x ^ (x >> _U(32)))


def bucket_of(keys: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """How many splitters are at or before each row, in the order of all keys."""
    low, high = (np.searchsorted(splitters[0], keys[0], side) for side in ("left", "right"))
    open_ = np.flatnonzero(low < high)  # rows that tie with splitters in the first key
    while len(open_):
        mid = (low[open_] + high[open_]) // 2
        after, tied = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for k, s in zip(keys, splitters):
            mine, cut = k[open_], s[mid]
            after |= tied & (mine > cut)
            tied &= mine == cut
        after |= tied
        low[open_[after]] = mid[after] + 1
        high[open_[~after]] = mid[~after]
        open_ = open_[low[open_] < high[open_]]
    return low


def _dealt(columns: list[pa.Array], splitters, schema: str, equal: int) -> pa.RecordBatch:
    """Rows with their bucket: by splitters or, given only a number of buckets, by a digest of the keys that rows compared with each other share."""
    keys = [columns[i].to_numpy() for i in range(4)]
    if splitters is None:
        bucket = np.zeros(len(keys[0]), np.int64)
    elif isinstance(splitters, int):
        mixed = sum(k.view(_U) * _BITS[i] for i, k in enumerate(keys[:equal]))
        bucket = (_mix(mixed ^ (mixed >> _U(32))) % _U(splitters)).astype(np.int64)
    else:
        bucket = bucket_of(keys, splitters)
    return pa.RecordBatch.from_arrays([*columns, pa.array(bucket.astype(np.int32))], names=_names(schema))


def _anchors(length: int, gram: int, of_words: bool, splitters=None):
    def run(batches):
        for batch in batches:
            ids, marks, texts = batch.column(0), batch.column(1), _texts_of(batch.column(2), of_words)
            for held, owner, place in segments(texts, length):
                h, left, starts = _hashed(held)
                first, last, anchor = runs_of(h, left, length, gram)
                if not len(first):
                    continue
                part = np.searchsorted(starts, first, "right") - 1
                digest = _mix(h.window(first, last - first + length, 1) + (last - first).astype(_U))
                who = pa.array(owner[part])
                doc, mark, at = ids.take(who), marks.take(who), first - starts[part] + place[part]
                keys = [_signed(x) for x in (h.leads(anchor), h.window(anchor, gram), digest, _spread(doc, mark, at))]
                yield _dealt([*keys, doc, mark, pa.array(at), pa.array(last - first + 1)], splitters, _ANCHORS, 2)

    return run


def _windows(length: int, of_words: bool, splitters=None):
    def run(batches):
        for batch in batches:
            ids, marks, texts = batch.column(0), batch.column(1), _texts_of(batch.column(2), of_words)
            runs = batch.column(3)
            ends, flat = runs.offsets.to_numpy() - runs.offsets[0].as_py(), runs.flatten()
            firsts, sizes = (flat.field(i).to_numpy() for i in range(2))
            for i, text in enumerate(texts):
                low, size = firsts[ends[i] : ends[i + 1]], sizes[ends[i] : ends[i + 1]]
                for at in range(0, len(text), SEGMENT):
                    a, b = np.maximum(low, at), np.minimum(low + size, at + SEGMENT)
                    a, b = a[a < b], b[a < b]
                    if not len(a):
                        continue
                    base, end = a.min(), b.max()
                    h, _, _ = _hashed([text[base : end + length - 1]])
                    s = np.unique(np.concatenate([np.arange(x, y) for x, y in zip(a, b)])) - base
                    who = pa.array(np.full(len(s), i))
                    doc, mark = ids.take(who), marks.take(who)
                    keys = [_signed(x) for x in (h.leads(s), h.window(s, length), h.window(s, length, 1), _spread(doc, mark, s + base))]
                    yield _dealt([*keys, doc, mark, pa.array(s + base)], splitters, _WINDOWS, 3)

    return run


def _splitters(sample: DataFrame, keys: str, buckets: int) -> list[np.ndarray] | int:
    """The keys at the quantiles of a sample, which is of SAMPLE_ROWS at most; the number of buckets if the sample has fewer rows."""
    columns = _names(keys)
    rows = sample.select(*columns).orderBy(F.xxhash64(*columns)).limit(SAMPLE_ROWS).toArrow()
    found = [rows.column(i).to_numpy() for i in range(4)]
    if len(rows) < buckets:
        return buckets
    at = np.lexsort(found[::-1])[np.arange(1, buckets) * len(rows) // buckets]
    return [k[at] for k in found]


def multikey_sort(words: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order of rows by their words, for each depth the number of each row's group of equal words, in that order).

    Quicksort by one word, then by the next only inside groups that are still equal.
    """
    order = np.argsort(words[0], kind="quicksort")
    group = np.cumsum(np.r_[0, words[0][order][1:] != words[0][order][:-1]])
    depths = [group]
    for w in words[1:]:
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        rows = order[tied]
        order[tied] = rows[np.lexsort((w[rows], group[tied]))]
        now = w[order]
        group = np.cumsum(np.r_[0, (group[1:] != group[:-1]) | (now[1:] != now[:-1])])
        depths.append(group)
    return order, depths


def _bucket(batches) -> pa.Table | None:
    held = [b for b in batches if len(b)]
    return pa.Table.from_batches(held).combine_chunks() if held else None


_VERDICTS = "lead long, gram long, run long, doc long, mark long, first long, size long, kind string, n_run long, n_group long"


def _ends(group: np.ndarray) -> np.ndarray:
    """The first rows of a bucket's first and last groups: only these groups can go on in other buckets."""
    return np.unique([0, int(np.searchsorted(group, group[-1]))])


def _sort_anchors(batches):
    """covered, goes_on, and both (an equal set's one run) rows; and an edge row for the bucket's first and last runs.

    Whether a group at an edge has runs elsewhere isn't known here, so one run of each of its equal sets
    goes on in any case. Where such a run is alone here, its edge row stands for it.
    """
    table = _bucket(batches)
    if table is None:
        return
    order, (_, group, run) = multikey_sort([table.column(i).to_numpy() for i in range(3)])
    n_group, n_run = np.bincount(group)[group], np.bincount(run)[run]
    single, at_edge = n_run == 1, (group == 0) | (group == group[-1])
    mixed = (np.bincount(group, weights=single)[group] > 0) | at_edge
    first = np.r_[True, run[1:] != run[:-1]]
    kind = np.where(single, "goes_on", np.where(mixed & first, "both", "covered"))
    ends = _ends(run)
    keep = n_group > 1
    keep[ends] &= ~single[ends]
    rows = np.concatenate([np.flatnonzero(keep), ends])
    kind = np.concatenate([kind[keep], np.full(len(ends), "edge")])
    out = table.select(_names(_VERDICTS)[:7]).take(pa.array(order[rows])).append_column("kind", pa.array(kind)).append_column("n_run", pa.array(n_run[rows])).append_column("n_group", pa.array(n_group[rows]))
    yield from out.to_batches()


_EQUALS = "lead long, one long, two long, doc long, mark long, first long, n long, edge boolean"


def _sort_windows(batches):
    """Rows of windows that meet an equal one; and an edge row for the bucket's first and last windows."""
    table = _bucket(batches)
    if table is None:
        return
    order, depths = multikey_sort([table.column(i).to_numpy() for i in range(3)])
    n, ends = np.bincount(depths[-1])[depths[-1]], _ends(depths[-1])
    equal = np.flatnonzero(n > 1)
    rows = np.concatenate([equal, ends])
    yield from table.select(_names(_EQUALS)[:6]).take(pa.array(order[rows])).append_column("n", pa.array(n[rows])).append_column("edge", pa.array(np.arange(len(rows)) >= len(equal))).to_batches()


def _edge_runs(edges: DataFrame) -> DataFrame:
    """Verdicts on runs alone in their bucket, from the edge rows of all buckets: two for each bucket."""
    group, run = Window.partitionBy("lead", "gram"), Window.partitionBy("lead", "gram", "run")
    met = edges.withColumns({"in_group": F.sum("n_group").over(group), "in_run": F.sum("n_run").over(run)}).where("n_run = 1 and in_group > 1")
    return met.select("doc", "mark", "first", "size", F.when(F.col("in_run") > 1, "both").otherwise("goes_on").alias("kind"))


def _buckets(docs: DataFrame, size: int, each: int) -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // each)


def _one_of(docs: DataFrame, n: int):
    """Documents of which there are about SAMPLE_DOCS among n, by a digest of their keys."""
    return F.pmod(F.xxhash64("doc", "mark"), F.lit(max(1, n // SAMPLE_DOCS))) == 0


def repeated_spans(docs: DataFrame, length: int = 400, of_words: bool = False) -> DataFrame:
    """(doc, mark, spans) of each text with bytes to remove; spans: array of (first, size). docs: doc, mark, text.

    of_words: places and ``length`` are of words, not of bytes.
    """
    gram = length // 2 if of_words else length * 16 // 25
    if gram < 12:
        raise ValueError("length is too small")
    least = 2 * length - 1 if of_words else length  # a word and its space take two bytes at least, the last word one
    long_ = docs.where(F.octet_length("text") >= least)
    n_docs, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    n = _buckets(docs, n_bytes, BUCKET_BYTES)
    cuts = _splitters(long_.where(_one_of(docs, n_docs)).mapInArrow(_anchors(length, gram, of_words), _ANCHORS), _KEYS, n)
    dealt = long_.mapInArrow(_anchors(length, gram, of_words, cuts), _ANCHORS).repartitionById(n, F.col("bucket"))
    sorted_ = store.materialise(dealt.mapInArrow(_sort_anchors, _VERDICTS), "anchors")
    plain = ["doc", "mark", "first", "size", "kind"]
    verdicts = sorted_.where("kind <> 'edge'").select(*plain).unionByName(_edge_runs(sorted_.where("kind = 'edge'")))
    covered = verdicts.where("kind in ('covered', 'both')").select("doc", "mark", "first", (F.col("size") + length - 1).alias("size"))
    going = verdicts.where("kind in ('goes_on', 'both')").groupBy("doc", "mark").agg(F.collect_set(F.struct("first", "size")).alias("runs"))
    # Splitters come from documents with open runs, however rare those are.
    going = store.materialise(going, "open")
    n_open, n_windows = going.agg(F.count("*"), F.coalesce(F.sum(F.expr("aggregate(runs, 0L, (n, r) -> n + r.size)")), F.lit(0))).first()
    n = _buckets(docs, n_windows, BUCKET_WINDOWS)
    thin = max(1, n_windows // max(1, n_open // SAMPLE_DOCS) // SAMPLE_ROWS)
    # About SAMPLE_DOCS keys, never more than four times that, so that no other document's text is moved for the sample.
    picked = going.where(_one_of(docs, n_open)).limit(4 * SAMPLE_DOCS)
    keys = F.broadcast(picked.select(F.col("doc").alias("other_doc"), F.col("mark").alias("other_mark")))
    texts = long_.join(keys, F.col("doc").eqNullSafe(F.col("other_doc")) & (F.col("mark") == F.col("other_mark")), "left_semi")
    some = _with(texts, going.where(_one_of(docs, n_open)), "runs").mapInArrow(_windows(length, of_words), _WINDOWS).where(F.pmod("spread", F.lit(thin)) == 0)
    cuts = _splitters(some, _WINDOW_KEYS, n)
    open_ = _with(long_, going, "runs").mapInArrow(_windows(length, of_words, cuts), _WINDOWS).repartitionById(n, F.col("bucket"))
    equal = store.materialise(open_.mapInArrow(_sort_windows, _EQUALS), "windows")
    place = ["doc", "mark", "first"]
    across = F.sum("n").over(Window.partitionBy("lead", "one", "two"))
    edges = equal.where("edge").withColumn("across", across).where("n = 1 and across > 1")
    met = equal.where("not edge").select(*place).unionByName(edges.select(*place))
    spans = covered.unionByName(met.select(*place, F.lit(length).cast("long").alias("size")))
    return spans.groupBy("doc", "mark").agg(F.collect_set(F.struct("first", "size")).alias("spans"))


def _with(docs: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """Documents that have a row in found; the others' texts aren't moved further than this join."""
    other = found.select(F.col("doc").alias("other_doc"), F.col("mark").alias("other_mark"), column)
    return docs.join(other, F.col("doc").eqNullSafe(F.col("other_doc")) & (F.col("mark") == F.col("other_mark"))).select("doc", "mark", "text", column)


def _marked(spans: DataFrame, of_words: bool) -> DataFrame:
    return spans.select("doc", "mark", F.transform("spans", lambda s: s.withField("of_words", F.lit(of_words))).alias("spans"))


def _union(rows: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, end) of the maximal spans of each row, in order."""
    order = np.lexsort((first, rows))
    rows, first = rows[order], first[order]
    base = rows << 40
    end = np.maximum.accumulate(base + first + size[order])
    new = np.flatnonzero(np.r_[True, (base + first)[1:] > end[:-1]][: len(rows)])
    return rows[new], first[new], (end[np.r_[new[1:], len(end)] - 1] - base[new]) if len(new) else first[new]


def _in_bytes(texts: list[bytes], rows: np.ndarray, first: np.ndarray, size: np.ndarray, of_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and size in bytes of spans of which those of words are counted in words."""
    first, size = first.copy(), size.copy()
    found = np.flatnonzero(of_words)  # rows are in order
    for mine in np.split(found, np.flatnonzero(np.diff(rows[found])) + 1) if len(found) else []:
        row = rows[mine[0]]
        places = np.array([m.span() for m in re.finditer(rb"\S+", texts[row])])
        end = places[first[mine] + size[mine] - 1, 1]
        first[mine] = places[first[mine], 0]
        size[mine] = end - first[mine]
    return first, size


def _result(text: str) -> str:
    return f"doc_id long, mark long, text {text}, n_bytes long, n_removed long, n_spans long"


def _cut(decode: bool):
    """What is left of texts: bytes, or text without the characters that a cut fell into."""
    kind = pa.large_string() if decode else pa.large_binary()

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary()).to_pylist()
            spans = batch.column(3)
            flat, rows = spans.flatten(), np.repeat(np.arange(len(batch)), np.diff(spans.offsets.to_numpy()))
            first, size = (flat.field(i).to_numpy() for i in range(2))
            if flat.type.num_fields > 2:
                first, size = _in_bytes(texts, rows, first, size, flat.field(2).to_numpy(zero_copy_only=False))
            rows, first, end = _union(rows, first, size)
            cuts, kept = np.searchsorted(rows, np.arange(len(batch) + 1)), []
            for i, text in enumerate(texts):
                mine = slice(cuts[i], cuts[i + 1])
                parts = [text[a:b] for a, b in zip([0, *end[mine].tolist()], [*first[mine].tolist(), len(text)])]
                kept.append("".join(p.decode(errors="ignore") for p in parts) if decode else b"".join(parts))
            n = np.diff(np.concatenate([[0], np.cumsum(end - first)])[cuts])
            columns = [batch.column(0), batch.column(1), pa.array(kept, kind).cast(pa.string() if decode else pa.binary()), pa.array([*map(len, texts)], pa.int64()), pa.array(n), pa.array(np.diff(cuts).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=_names(_result("")))

    return run


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, mark and text: a row is known by its id and a digest of its text; equal rows are treated alike."""
    return store.small_batches(docs).select(F.col(key).alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"), F.coalesce(text, F.lit("")).alias("text"))


def remove_repeats(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text", with_mark: bool = False, decode: bool = False, n_words: int | None = None) -> DataFrame:
    """doc_id, text (what is left, binary), n_bytes, n_removed and n_spans of texts that lose bytes; all others have no row.

    with_mark: also the mark of the whole text, as ``keyed`` has it. decode: the text as a string,
    without characters of which a cut has left a part. n_words: runs of so many words that also start
    elsewhere go too, however short and whatever white space is between them.
    """
    rows = keyed(docs, key, text)
    spans = repeated_spans(rows, length)
    if n_words:
        both = _marked(spans, False).unionByName(_marked(repeated_spans(rows, n_words, of_words=True), True))
        spans = both.groupBy("doc", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    cut = _with(rows, spans, "spans").mapInArrow(_cut(decode), _result("string" if decode else "binary"))
    return cut if with_mark else cut.drop("mark")


def repeat_report(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    rows = keyed(docs, key, text)
    spans = store.materialise(repeated_spans(rows, length), "spans")
    cut = _with(rows, spans, "spans").mapInArrow(_cut(False), _result("binary")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))
    whole = rows.select("doc", "mark", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256"))
    found = spans.select(F.col("doc").alias("other_doc"), F.col("mark").alias("other_mark"))
    rest = whole.join(found, F.col("doc").eqNullSafe(F.col("other_doc")) & (F.col("mark") == F.col("other_mark")), "left_anti")
    zero = F.lit(0).cast("long")
    return cut.unionByName(rest.select(F.col("doc").alias("doc_id"), "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256"))
