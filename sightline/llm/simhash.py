"""SimHash near-duplicates: fingerprints, and links within a Hamming radius by a Gray-order index.

A fingerprint has 64 bits; two link at ``radius`` or fewer differing bits. Fingerprints that close
agree in at least two of ``radius`` + 2 bit blocks, so every distinct fingerprint goes to one group
for each pair of blocks. In a group they are sorted by Gray rank, under which neighbours differ in
few bits, and a tree is built over runs of that order: a node keeps the bits that all below it share
beyond those its parent shares, and a search adds up the differences in shared bits on its way down
and drops a whole node once they exceed the radius. A node whose members are all linked to the
searched fingerprint already is dropped too, so a dense group costs no more than it has members
to join. Groups of over UNIT fingerprints are cut into parts, and each pair of parts is searched on
its own. Each group returns one link for each member joined; components come from these.

Cases: null and empty texts have fingerprint zero, linked like any other; texts with fewer words than
a shingle have one shingle; repeated rows get a row each; null ids are kept, and a component of only
null ids has a null id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .components import connected_components
from .tokens import text_slices

SEED = 42
#: Distinct fingerprints of a group that one search takes.
UNIT = 4096
LEAF, FAN = 16, 8
_ROUND = 100_000  # shingles counted at a time
SLICE = 4_000_000  # bytes of text taken at a time
SALTS = 32


def shingle_digests(data: bytes, size: int) -> list[bytes]:
    """XXH64 of each run of ``size`` words of ASCII-lower-cased UTF-8, repeats included."""
    from xxhash import xxh64_digest

    words = data.lower().split()
    if len(words) <= size:
        return [xxh64_digest(b" ".join(words), SEED)] if words else []
    joined, at, starts, ends = b" ".join(words), 0, [], []
    for w in words:
        starts.append(at)
        at += len(w) + 1
        ends.append(at - 1)
    return [xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])]


def fingerprints_of(texts: pa.LargeStringArray, size: int) -> np.ndarray:
    """The fingerprint of each text: bits set in over half of its shingles' hashes."""
    ones, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held, owners, n = [], [], 0

    def add():
        if held:
            bits = np.unpackbits(np.frombuffer(b"".join(held), np.uint8).reshape(-1, 8), axis=1)
            runs = np.asarray(owners)
            ones[runs[:, 0]] += np.add.reduceat(bits, runs[:, 1], axis=0, dtype=np.int64)

    for i, data in enumerate(pc.cast(texts, pa.large_binary())):
        found = shingle_digests(data.as_py(), size)
        totals[i] = len(found)
        for at in range(0, len(found), _ROUND):
            part = found[at : at + _ROUND]
            owners.append((i, n))
            held.append(b"".join(part))
            n += len(part)
            if n >= _ROUND:
                add()
                held, owners, n = [], [], 0
    add()
    return np.packbits(2 * ones > totals[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _remixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Another hash from each hash (the finaliser of splitmix64)."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, size: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint as a long) of every row."""

    def run(batches):
        for (ids,), texts in text_slices(batches, [key], text, SLICE):
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(fingerprints_of(texts, size).view(np.int64))], names=["doc_id", "fingerprint"])

    return store.small_batches(docs).select(key, text).mapInArrow(run, "doc_id long, fingerprint long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """A tree over fingerprints (rows of one or more words) in Gray order, by their first word."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes[:, 0]), kind="stable")
        self.codes = codes[self.order]
        self.label = np.arange(len(codes))
        all_, any_, self.levels = self.codes, self.codes, []
        width = LEAF
        while True:
            at = np.arange(0, len(all_), width)
            all_, any_ = np.bitwise_and.reduceat(all_, at), np.bitwise_or.reduceat(any_, at)
            self.levels.append((~(all_ ^ any_), all_))
            width = FAN
            if len(all_) == 1:
                break
        self.levels.reverse()
        for i in range(len(self.levels) - 1, 0, -1):  # bits that the parent shares already count there
            mask, pattern = self.levels[i]
            self.levels[i] = (mask & ~np.repeat(self.levels[i - 1][0], FAN, axis=0)[: len(mask)], pattern)

    def links(self, radius: int, alike=None) -> tuple[np.ndarray, np.ndarray]:
        """(row, first row) of every member joined to another through codes within the radius.

        alike: says of which of such pairs (rows, other rows) join.
        """
        step = max(1, 2_000_000 // self.codes.size)
        for at in range(0, len(self.codes), step):
            q, m = self._near(np.arange(at, min(at + step, len(self.codes))), radius)
            if alike:
                q, m = q[q < m], m[q < m]  # the other half has been here or comes
                good = alike(self.order[q], self.order[m])
                q, m = q[good], m[good]
            self._join(q, m)
        own = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.order[own], self.order[self.label[own]]

    def _near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        q, node, off = queries, np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        joined = self._joined()
        for depth, (mask, pattern) in enumerate(self.levels):
            off = off + _ones((self.codes[q] ^ pattern[node]) & mask[node])
            keep = (off <= radius) & (joined[depth][node] != self.label[q])
            q, node, off = q[keep], node[keep], off[keep]
            fan, n = (FAN, len(self.levels[depth + 1][0])) if depth + 1 < len(self.levels) else (LEAF, len(self.codes))
            q, off, node = np.repeat(q, fan), np.repeat(off, fan), (node[:, None] * fan + np.arange(fan)).ravel()
            keep = node < n
            q, node, off = q[keep], node[keep], off[keep]
        near = (_ones(self.codes[q] ^ self.codes[node]) <= radius) & (self.label[q] != self.label[node])
        return q[near], node[near]

    def _joined(self) -> list[np.ndarray]:
        """For each level the label that all members of a node have, or -1."""
        low = high = self.label
        out, width = [], LEAF
        for _ in self.levels:
            at = np.arange(0, len(low), width)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append(np.where(low == high, low, -1))
            width = FAN
        return out[::-1]

    def _join(self, q: np.ndarray, m: np.ndarray) -> None:
        label = self.label
        while len(q):
            a, b = label[q], label[m]
            apart = a != b
            q, m, a, b = q[apart], m[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label[:] = up


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


def _links_in(groups: np.ndarray, codes: np.ndarray, radius: int, alike=None) -> tuple[np.ndarray, np.ndarray]:
    """Links (rows) in every run of equal groups; runs of up to LEAF are leaves by themselves and compared directly."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    left, right = [], []
    small = np.repeat(sizes <= LEAF, sizes)
    end = np.repeat(starts + sizes, sizes)
    for d in range(1, LEAF):
        i = np.flatnonzero(small & (np.arange(len(codes)) + d < end))
        if not len(i):
            break
        i = i[_ones(codes[i] ^ codes[i + d]) <= radius]
        if alike:
            i = i[alike(i, i + d)]
        left.append(i + d)
        right.append(i)
    for at, n in zip(starts[sizes > LEAF], sizes[sizes > LEAF]):
        a, b = GrayIndex(codes[at : at + n]).links(radius, alike and (lambda q, m, at=at: alike(at + q, at + m)))
        left.append(at + a)
        right.append(at + b)
    return (np.concatenate(left), np.concatenate(right)) if left else (starts[:0], starts[:0])


def near_links(codes: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links that join the same distinct fingerprints as all pairs within the radius do."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    masks = [sum(1 << bit for bit in range(edges[i], edges[i + 1])) for i in range(n)]
    pairs = [(masks[i] | masks[j]) for i, j in itertools.combinations(range(n), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in pairs]
    keyed = codes.select(F.col("fingerprint").alias("node"), F.array("fingerprint").alias("code"), F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m)) for m in signed])).alias("pair", "bits"))
    # Most groups hold one fingerprint: only the others are moved with what they hold.
    counts = keyed.groupBy("pair", "bits").agg(F.count("*").alias("of"), F.count("*").alias("total")).where("of > 1")
    return _group_links(keyed.join(counts, ["pair", "bits"]).withColumn("key", F.xxhash64("pair", "bits")), radius)


def _group_links(members: DataFrame, radius: int, exact: bool = False) -> DataFrame:
    """(a, b): links that join the members of each key as all its pairs within the radius do, or of these all that are alike.

    members: key, node, code, of and total, the members of the key and the shingles of these; for exact also grams.
    Groups of over UNIT members or GRAMS shingles are searched in parts: a part meets itself and every other part once.
    """
    parts = F.greatest(F.ceil(F.col("of") / UNIT), F.ceil(F.col("total") / GRAMS)).cast("int")
    mine = F.pmod(F.xxhash64("node"), parts).cast("int")
    lists = ["code", *["grams"] * exact]
    units = members.select("key", "node", *lists, mine.alias("mine"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    unit = units.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), "node", *lists)

    def found(held):
        table = pa.Table.from_batches(held).combine_chunks()
        groups, nodes, codes = table.column(0).to_numpy(), table.column(1).to_numpy(), _words(table.column(2))
        codes = codes.reshape(len(groups), -1)
        alike = _alike(codes, _words(table.column(3)), table.column(3).chunk(0).value_lengths().to_numpy()) if exact else None
        a, b = _links_in(groups, codes, radius, alike)
        return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], names=["a", "b"])

    def run(batches):
        held, last = [], None
        for batch in batches:
            if not len(batch):
                continue
            groups = batch.column(0).to_numpy()
            cut = int(np.searchsorted(groups, groups[-1]))  # the last group may go on in the next batch
            if held and (cut or groups[-1] != last):
                yield found([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield found([batch.slice(0, cut)])
            held.append(batch.slice(cut))
            last = groups[-1]
        if held:
            yield found(held)

    # Two units with the same hash only share a search; they lose or add no link that isn't one.
    return unit.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


def _words(column: pa.ChunkedArray) -> np.ndarray:
    return column.chunk(0).flatten().to_numpy().view(np.uint64)


def _alike(codes: np.ndarray, grams: np.ndarray, sizes: np.ndarray):
    """A check of pairs of rows: whether their sets of shingles, which lie one after another in order, are alike."""
    ends = np.cumsum(sizes)

    def check(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
        fit = (low * ALIKE[1] >= high * ALIKE[0]) & (_ones(codes[a] ^ codes[b]) <= np.where(low < FEW, FAR_FEW, FAR))
        good, at = np.zeros(len(a), bool), np.flatnonzero(fit)
        for some in np.split(at, np.flatnonzero(np.diff(a[at])) + 1) if len(at) else []:
            one, n, others = a[some[0]], sizes[a[some[0]]], b[some]
            mine = grams[ends[one] - n : ends[one]]
            theirs = np.concatenate([grams[ends[o] - sizes[o] : ends[o]] for o in others])
            same = mine[np.minimum(np.searchsorted(mine, theirs), n - 1)] == theirs
            shared = np.add.reduceat(same, np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
            good[some] = shared * ALIKE[1] >= (n + sizes[others] - shared) * ALIKE[0]
        return good

    return check


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (a long) and component_id, the smallest doc_id reachable, of every row."""
    found = store.materialise(fingerprints(docs, size, key, text), "fingerprints")
    classes = found.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    components = connected_components(near_links(classes.select("fingerprint"), radius))
    joined = store.materialise(classes.join(components, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first_id", "component"), "classes")
    linked = joined.where("component is not null").withColumn("salt", F.pmod(F.xxhash64("fingerprint"), F.lit(SALTS)).cast("int"))
    # A component may hold very many classes: its lowest id is dealt out to SALTS keys.
    lowest = linked.groupBy("component").agg(F.min("first_id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    alone = joined.where("component is null").select("fingerprint", F.col("first_id").alias("component_id"))
    of_class = store.materialise(linked.join(lowest, ["component", "salt"]).select("fingerprint", "component_id").unionByName(alone), "components")
    return found.join(of_class, "fingerprint").select("doc_id", "fingerprint", "component_id")


#: Near copies share at least ALIKE[0] of ALIKE[1] of their distinct shingles (Jaccard).
ALIKE = (4, 5)
#: Texts are compared if they share one of BANDS keys of ROWS MinHash values: a pair at 0.8 shares none with probability 4e-4.
BANDS, ROWS = 20, 5
#: Words of the fingerprints that choose the pairs. Of their 1024 bits a pair at 0.8 differs in 155 on average with a deviation
#: of 11.5, and is compared up to FAR; pairs of texts of under FEW shingles, whose sums tie more often, are up to FAR_FEW.
WIDE, FAR, FEW, FAR_FEW = 16, 196, 64, 250
#: Shingles of a group that one search takes, about.
GRAMS = 2_000_000
_SALTS = _remixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64), 1) | np.uint64(1)
_SKETCH = "doc_id long, mark long, node long, n long, keys array<long>"
_SETS = "node long, grams array<long>, code array<long>"
#: Shingles counted at a time where fingerprints are wide, and the rows of a slice.
_PART, _ROWS = 16_384, 2_000


def distinct_shingles(data: bytes, size: int) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(shingle_digests(data, size)), ">u8").astype(np.uint64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS keys of each set of shingles; empty sets have keys too."""
    lows = np.full((BANDS * ROWS, len(sets)), np.uint64(2**64 - 1))
    filled = [i for i, x in enumerate(sets) if len(x)]
    for part in _parts(filled, [len(sets[i]) for i in filled], _PART * 16):
        hashes = np.concatenate([sets[i] for i in part])
        starts = np.cumsum([0, *(len(sets[i]) for i in part[:-1])])
        for i, salt in enumerate(_SALTS):
            lows[i, part] = np.minimum.reduceat(hashes * salt, starts)
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band, np.uint64)
        for low in lows[band * ROWS : (band + 1) * ROWS]:
            key = _remixed(key ^ low, 1)
        keys[:, band] = key
    return keys


def wide_codes(sets: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of WIDE words of each set of shingles."""
    out = np.zeros((len(sets), WIDE), np.uint64)
    for i, x in enumerate(sets):
        for w in range(WIDE):
            ones = np.zeros(64, np.int64)
            for at in range(0, len(x), _PART):
                ones += np.unpackbits(_remixed(x[at : at + _PART], w + 1).view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            out[i, w] = np.packbits(2 * ones > len(x)).view(np.uint64)[0]
    return out


def _parts(items: list, sizes: list[int], most: int):
    """Runs of the items of about ``most`` in all."""
    held, total = [], 0
    for item, size in zip(items, sizes):
        if held and total + size > most:
            yield held
            held, total = [], 0
        held.append(item)
        total += size
    if held:
        yield held


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.ravel().view(np.int64)))


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """docs: doc_id, mark, text. node: a digest of the set of shingles, n: its size."""

    def run(batches):
        from xxhash import xxh64_intdigest

        for (ids, marks), texts in text_slices(batches, ["doc_id", "mark"], "text", SLICE, _ROWS):
            sets = [distinct_shingles(x.as_py(), size) for x in pc.cast(texts, pa.large_binary())]
            nodes = np.array([xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64)
            columns = [ids.cast(pa.int64()), marks, pa.array(nodes.view(np.int64)), pa.array([len(x) for x in sets], pa.int64()), _lists(band_keys(sets))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SKETCH.split(", ")])

    return docs.mapInArrow(run, _SKETCH)


def _shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """The distinct shingles and the wide fingerprint of each text. docs: node, text."""

    def run(batches):
        for (nodes,), texts in text_slices(batches, ["node"], "text", SLICE, _ROWS):
            sets = [distinct_shingles(x.as_py(), size) for x in pc.cast(texts, pa.large_binary())]
            grams = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)], dtype=np.int32), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([nodes, grams, _lists(wide_codes(sets))], names=[c.split()[0] for c in _SETS.split(", ")])

    return docs.mapInArrow(run, _SETS)


def alike_links(classes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(a, b): links that join the classes as all pairs with a Jaccard similarity of ALIKE do that share a key and have near fingerprints.

    classes: doc_id, mark, node, n, keys; texts: doc_id, mark, text.
    """
    keyed = classes.where("n > 0").select("node", "n", F.explode("keys").alias("key"))
    own = [F.expr(f"bit_xor(xxhash64(node, {i}))").alias(f"own{i}") for i in range(2)]
    shared = keyed.groupBy("key").agg(F.count("*").alias("of"), F.sum("n").alias("total"), *own).where("of > 1")
    # Near copies share many keys: of keys with the same nodes one is searched.
    searched = shared.groupBy("of", "total", "own0", "own1").agg(F.min("key").alias("key")).select("key", "of", "total")
    groups = store.materialise(keyed.join(searched, "key").select("key", "node", "of", "total"), "groups")
    chosen = classes.join(groups.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("id"), F.col("mark").alias("id_mark"))
    one = texts.join(chosen, (F.col("doc_id") == F.col("id")) & (F.col("mark") == F.col("id_mark"))).dropDuplicates(["node"])
    sets = store.materialise(_shingle_sets(one.select("node", "text"), size), "shingle-sets")
    return _group_links(groups.join(sets, "node"), FAR_FEW, exact=True)


def keep_one(docs: DataFrame, size: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but the first of each group of near copies; rows with a null id are left alone.

    Near copies have a Jaccard similarity of ALIKE in their distinct shingles, or are linked by such
    pairs. MinHash keys and SimHash fingerprints only choose the pairs; their shingles are then compared.
    A row is known by its id and its text: different texts with one id are different documents, and of rows
    equal in both one stays. The first of a group is that with the smallest id, on ties with the smallest digest of its text.
    """
    # Own columns travel in one, whatever they are named.
    known = store.small_batches(docs).where(F.col(key).isNotNull()).select(F.struct("*").alias("whole"), F.col(key).alias("own_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("own_mark"))
    texts = known.select(F.col("own_id").alias("doc_id"), F.col("own_mark").alias("mark"), F.coalesce(F.col("whole")[text], F.lit("")).alias("text"))
    found = store.materialise(_sketches(texts, size), "sketches")
    who = F.min(F.struct("doc_id", "mark")).alias("who")
    classes = store.materialise(found.groupBy("node").agg(who, F.first(F.struct("n", "keys")).alias("s")).select("node", "who.*", "s.*"), "classes")
    components = connected_components(alike_links(classes, texts, size))
    joined = classes.select("node", "doc_id", "mark").join(components.withColumnRenamed("node", "other"), F.col("node") == F.col("other"), "left")
    firsts = joined.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min(F.struct("doc_id", "mark")).alias("who"))
    firsts = firsts.select(F.col("who.doc_id").alias("kept_id"), F.col("who.mark").alias("kept_mark"))
    kept = known.join(firsts, (F.col("own_id") == F.col("kept_id")) & (F.col("own_mark") == F.col("kept_mark")), "left_semi").dropDuplicates(["own_id", "own_mark"])
    return kept.select("whole.*").unionByName(docs.where(F.col(key).isNull()))
