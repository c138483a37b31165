"""Collocations of two to four words, counted by weighted acyclic automata.

Texts are cut into pieces at punctuation and line ends and into words at spaces. All n-grams of one to
``LONGEST`` words inside pieces are counted for each language:

1. A task numbers a block's words in the order of their digests, sorts the block's n-grams and appends
   them to a transducer, an acyclic automaton whose states are the n-grams that occur: each arc has a
   word and the count of the n-gram that ends with it. As n-grams arrive sorted, each shares its first
   words with the one before. The transducer is cut at splitters, quantiles of the n-grams of sampled
   documents, so that a range of prefixes is a part of bounded size however common its words are.
2. The parts of a range are united level by level: arcs with the same word from states that are the same
   become one arc with the sum of their weights. N-grams below ``least`` go. What is left of a range is
   written to a file.
3. Each candidate and each cut of it asks for the counts of both its parts. Questions are sorted by the
   range that holds the part, a task composes them with the range's transducer, walking all of them
   through it at once, and the counts go back to the candidate.

Words are 64-bit digests inside; the words themselves travel once for each block, with the part that holds
them as n-grams of one word, and name the candidates at the end.

Cases: null texts are empty; a null language is ``und``; empty texts and those of separators alone have no
words; repeated rows count each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import uuid
from array import array
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .suffixes import bucket_of

LONGEST = 4
#: Words counted at a time, at most.
BLOCK_WORDS = 1_000_000
#: Different words of a block, at most: their numbers have 16 bits.
MOST_WORDS = 0xFFFF
#: Documents sampled for splitters, about, and n-grams taken of them.
SAMPLE_DOCS, SAMPLE_ROWS = 4000, 40_000
#: N-grams whose digests are held at a time, and rows sent at a time.
SLICE, SEND_ROWS = 200_000, 20_000
#: Bytes of text whose n-grams make a range, about.
RANGE_BYTES = 8_000_000

_U = np.uint64
_SPLIT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"..........\x20")
_PARTS = "kind int, range int, lang string, body binary"
_UNION = "kind int, range int, lang string, n long, name string, phrase binary, k int, side int, part binary"


class _Numbers(dict):
    """A number for each word, in the order of arrival, from 1; the dot is 0."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _tokens(text: bytes | None) -> list[bytes]:
    """Words of a text; a dot between pieces and at the end."""
    return ((text or b"").lower().translate(_SPLIT) + b".").replace(b".", b" . ").split()


def _digest(words: list[bytes]) -> np.ndarray:
    """Digests of words, of which none is 0."""
    from xxhash import xxh64_intdigest

    return np.array([*map(xxh64_intdigest, words)], _U) | _U(1)


class _Block:
    """Words of one language while they wait, as numbers of four bytes: a task holds a block of each language."""

    def __init__(self):
        self.numbers, self.ids = _Numbers(), array("I")

    def add(self, tokens: list[bytes]) -> None:
        self.ids.extend(map(self.numbers.__getitem__, tokens))

    def whole(self, after: list[bytes]) -> tuple[list[bytes], np.ndarray, int]:
        """(words by number, the numbers of all words in order, how many of these begin n-grams)."""
        n = len(self.ids)
        self.add(after + [b"."] * LONGEST)
        return [*self.numbers], np.frombuffer(self.ids, np.uintc), n


def _blocks(batches):
    """(language, words by number, numbers, how many of them begin n-grams) of BLOCK_WORDS of one language at most."""
    held: dict[str, _Block] = defaultdict(_Block)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
            tokens = _tokens(text)
            for at in range(0, len(tokens), BLOCK_WORDS):
                end = at + BLOCK_WORDS
                part, after = tokens[at:end], tokens[end : end + LONGEST - 1]
                if held[lang].ids and len(held[lang].ids) + len(part) > BLOCK_WORDS:
                    yield lang, *held.pop(lang).whole([])
                held[lang].add(part)
                if after or len(held[lang].numbers) > MOST_WORDS * 15 // 16:  # before a text takes it over MOST_WORDS, which would halve the block
                    yield lang, *held.pop(lang).whole(after)
        if sum(len(x.ids) for x in held.values()) > 4 * BLOCK_WORDS or sum(len(x.numbers) for x in held.values()) > 8 * MOST_WORDS:  # many languages of few words each
            for lang in [*held]:
                yield lang, *held.pop(lang).whole([])
    for lang in [*held]:
        yield lang, *held.pop(lang).whole([])


def _short(x: np.ndarray) -> np.ndarray:
    """The same numbers, none of which is negative, of the smallest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


class Transducer:
    """Counts of n-grams: for each length, in order, the number of the state each arc leaves, its word and its weight.

    The states after n words are the arcs of level n. ``digests``: of the words, in order, from number 1;
    ``words``: those that are n-grams here themselves, others are empty.
    """

    def __init__(self, digests: np.ndarray, words: list[bytes], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.digests, self.words, self.levels = digests, words, levels

    @classmethod
    def of_sorted(cls, digests: np.ndarray, words: list[bytes], grams: np.ndarray, weights: np.ndarray) -> "Transducer":
        """From different n-grams (rows of word numbers, 0 after the end) in order."""
        if len(grams):  # a cut may have left the first one's prefixes outside: they have no weight here
            size = int((grams[0] > 0).sum())
            above = np.zeros((size - 1, LONGEST), grams.dtype)
            for i in range(size - 1):
                above[i, : i + 1] = grams[0, : i + 1]
            grams, weights = np.concatenate([above, grams]), np.concatenate([np.zeros(size - 1, weights.dtype), weights])
        held = np.zeros(len(digests) + 1, bool)
        for i in range(LONGEST):
            held[grams[:, i]] = True
        held[0] = False
        used, numbers = np.flatnonzero(held), np.cumsum(held, dtype=np.uint32)
        size, levels, before = (grams > 0).sum(1), [], np.zeros(len(grams), np.int64)
        for n in range(1, LONGEST + 1):
            here = size == n
            levels.append((before[here].astype(np.uint32), numbers[grams[here, n - 1]], weights[here].astype(np.int64)))
            before = np.cumsum(here) - 1
        own = set(levels[0][1][levels[0][2] > 0].tolist())
        return cls(digests[used - 1], [words[i - 1] if n in own else b"" for n, i in enumerate(used.tolist(), 1)], levels)

    def dump(self) -> bytes:
        """Sources as steps from one to the next, all numbers as short as they are."""
        levels = [(_short(np.diff(s.astype(np.int64), prepend=0)), _short(label), _short(w)) for s, label, w in self.levels]
        return zstandard.compress(pickle.dumps((self.digests, b" ".join(self.words), levels), 5), 1)

    @classmethod
    def load(cls, data: bytes) -> "Transducer":
        digests, words, levels = pickle.loads(zstandard.decompress(data))
        wide = [(np.cumsum(s, dtype=np.int64).astype(np.uint32), label.astype(np.uint32), w.astype(np.int64)) for s, label, w in levels]
        return cls(digests, words.split(b" ") if words else [], wide)

    @classmethod
    def union(cls, parts: list["Transducer"]) -> "Transducer":
        """Weights of n-grams of several transducers, added up."""
        digests = np.unique(np.concatenate([p.digests for p in parts]))
        number = [np.concatenate([[0], np.searchsorted(digests, p.digests) + 1]) for p in parts]
        words = [b""] * len(digests)
        for p, m in zip(parts, number):
            for w, i in zip(p.words, m[1:].tolist()):
                if w:
                    words[i - 1] = w
        states, levels = [np.zeros(1, np.int64) for _ in parts], []
        for n in range(LONGEST):
            keys = [(s[p.levels[n][0]] << 32) | m[p.levels[n][1]] for p, s, m in zip(parts, states, number)]
            all_, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.zeros(len(all_), np.int64)
            np.add.at(sums, inverse, np.concatenate([p.levels[n][2] for p in parts]))
            levels.append(((all_ >> 32).astype(np.uint32), (all_ & 0xFFFFFFFF).astype(np.uint32), sums))
            states = np.split(inverse, np.cumsum([len(k) for k in keys])[:-1])
        return cls(digests, words, levels)

    def grams(self, n: int, arcs: np.ndarray) -> np.ndarray:
        """The words' numbers of arcs of level n, from the first word on."""
        out = np.zeros((len(arcs), n), np.int64)
        for i in range(n - 1, -1, -1):
            out[:, i] = self.levels[i][1][arcs]
            arcs = self.levels[i][0][arcs].astype(np.int64)
        return out

    def pruned(self, least: int) -> "Transducer":
        """Without n-grams of less weight, but with their states if longer ones stay."""
        keep = [w >= least for _, _, w in self.levels]
        for n in range(LONGEST - 1, 0, -1):
            keep[n - 1][self.levels[n][0][keep[n]]] = True
        levels, renamed = [], np.zeros(1, np.int64)
        for (source, label, weight), k in zip(self.levels, keep):
            levels.append((renamed[source[k]].astype(np.uint32), label[k], weight[k]))
            renamed = np.cumsum(k) - 1
        used = np.unique(np.concatenate([label for _, label, _ in levels])).astype(np.int64)
        levels = [(s, (np.searchsorted(used, label) + 1).astype(np.uint32), w) for s, label, w in levels]
        return Transducer(self.digests[used - 1], [self.words[i - 1] for i in used.tolist()], levels)

    def weights_of(self, digests: np.ndarray) -> np.ndarray:
        """Weights of n-grams, given as rows of their words' digests with 0 after the end; 0 of those that are not here."""
        state, out, going = np.zeros(len(digests), np.int64), np.zeros(len(digests), np.int64), np.ones(len(digests), bool)
        for n in range(digests.shape[1]):
            going &= digests[:, n] > 0
            at = np.searchsorted(self.digests, digests[:, n])
            known = going & (at < len(self.digests))
            known[known] = self.digests[at[known]] == digests[known, n]
            source, label, weight = self.levels[n]
            keys, mine = (source.astype(np.int64) << 32) | label, (state << 32) | (at + 1)
            to = np.searchsorted(keys, mine)
            known &= to < len(keys)
            known[known] = keys[to[known]] == mine[known]
            out[going] = 0
            state[known], out[known] = to[known], weight[to[known]]
            going = known
        return out


def _counted(words: list[bytes], ids: np.ndarray, n: int) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(digests, words, n-grams as keys in order, counts) of n-grams that start in the first n words. A key has the places of an n-gram's words among the digests, 16 bits each."""
    digests = _digest(words[1:])
    order = np.argsort(digests)
    rank = np.zeros(len(words), np.uint16)
    rank[order + 1] = np.arange(1, len(words))
    seq = rank[ids]
    key, keys, inside = np.zeros(n, _U), [], np.ones(n, bool)
    for i in range(LONGEST):
        word = seq[i : i + n]
        inside &= word > 0
        key |= word.astype(_U) << _U(48 - 16 * i)
        keys.append(key[inside])
    del key
    found = np.concatenate(keys)
    del keys
    found.sort()
    new = np.flatnonzero(np.r_[True, found[1:] != found[:-1]][: len(found)])
    return digests[order], [words[i + 1] for i in order.tolist()], found[new], np.diff(np.r_[new, len(found)]).astype(np.uint32)


def _rows_of(keys: np.ndarray) -> np.ndarray:
    """N-grams as rows of their words' numbers, 0 after the end."""
    return keys.astype(">u8").view(">u2").astype(np.uint16).reshape(-1, LONGEST)


def _columns(digests: np.ndarray, grams: np.ndarray) -> list[np.ndarray]:
    """Digests of n-grams by place, as signed numbers of the same order; the least for none."""
    held = np.concatenate([np.zeros(1, _U), digests])
    return [(held[grams[:, i]] ^ _U(1 << 63)).view(np.int64) for i in range(LONGEST)]


def _cuts(splitters: list[np.ndarray], digests: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many of a block's n-grams are at or before each splitter."""
    cut, known = np.zeros(len(splitters[0]), _U), np.ones(len(splitters[0]), bool)
    for i, s in enumerate(splitters):
        word = s.view(_U) ^ _U(1 << 63)
        at = np.searchsorted(digests, word)
        here = digests[np.minimum(at, len(digests) - 1)] == word
        # Of a word that isn't here, all n-grams with those before it in its place are before the splitter.
        cut |= np.where(known, at + here, 0xFFFF).astype(_U) << _U(48 - 16 * i)
        known &= here | (word == 0)
    return np.searchsorted(keys, cut, "right")


def _shard(splitters: list[np.ndarray]):
    """Parts of the transducers of blocks, by range."""

    def run(batches):
        for lang, (digests, words, keys, counts) in ((lang, x) for lang, *block in _blocks(batches) for x in _halves(*block)):
            if not len(keys):
                continue
            cuts = [0, *_cuts(splitters, digests, keys).tolist(), len(keys)]
            out = [(0, r, lang, Transducer.of_sorted(digests, words, _rows_of(keys[a:b]), counts[a:b]).dump()) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.binary()))], names=["kind", "range", "lang", "body"])

    return run


def _ranges_of(columns: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """The range of each n-gram: how many splitters are before it."""
    if not len(splitters[0]):
        return np.zeros(len(columns[0]), np.int64)
    at = bucket_of(columns, splitters)
    same = at > 0
    for c, s in zip(columns, splitters):
        same &= c == s[np.maximum(at - 1, 0)]
    return at - same


def _halves(words: list[bytes], ids: np.ndarray, n: int):
    """``_counted`` of a block, or of its parts until their words have numbers of 16 bits."""
    if len(words) - 1 <= MOST_WORDS:
        yield _counted(words, ids, n)
        return
    for a, b in ((0, n // 2), (n // 2, n)):
        mine = ids[a : b + LONGEST - 1]
        used = np.union1d([0], mine)
        yield from _halves([words[i] for i in used.tolist()], np.searchsorted(used, mine), b - a)


_SAMPLE = "a long, b long, c long, d long"


def _sampled(one_of: int):
    def run(batches):
        for digests, _, keys, _ in (x for _, *block in _blocks(batches) for x in _halves(*block)):
            for at in range(0, len(keys), SLICE):
                columns = _columns(digests, _rows_of(keys[at : at + SLICE]))
                mixed = sum(c.view(_U) * _U(2 * i + 0x9E3779B97F4A7C15) for i, c in enumerate(columns))
                few = (mixed >> _U(20)) % _U(one_of) == 0
                yield pa.RecordBatch.from_arrays([pa.array(c[few]) for c in columns], names=["a", "b", "c", "d"])

    return run


def _splitters(docs: DataFrame, size: int) -> list[np.ndarray]:
    """Quantiles of about SAMPLE_ROWS different n-grams of about SAMPLE_DOCS documents; none for one range. size: bytes of all texts."""
    ranges, none = 1 + size // RANGE_BYTES, [np.zeros(0, np.int64)] * LONGEST
    if ranges < 2:
        return none
    thin = max(1, docs.count() // SAMPLE_DOCS)
    few = docs.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(thin)) == 0)
    # A word and its space take about six bytes, and each begins LONGEST n-grams.
    rows = few.mapInArrow(_sampled(1 + size * LONGEST // 6 // thin // SAMPLE_ROWS), _SAMPLE).limit(4 * SAMPLE_ROWS).toArrow()
    columns = [rows.column(i).to_numpy() for i in range(LONGEST)]
    if not len(rows):
        return none
    at = np.lexsort(columns[::-1])[np.arange(1, ranges) * len(rows) // ranges]
    cuts = np.unique(np.stack([c[at] for c in columns], 1), axis=0)
    return [np.ascontiguousarray(cuts[:, i]) for i in range(LONGEST)]


def _union(splitters: list[np.ndarray], least: int, folder: str):
    """Unites the parts of each range in a partition, which arrive in the order of ranges: words of each language (kind 1), the file of its transducers (2), its candidates' questions (3), its words (4)."""

    def finish(number: int, parts: dict[str, list[Transducer]]):
        whole = {}
        for lang, found in parts.items():
            t = Transducer.union(found) if len(found) > 1 else found[0]
            yield (1, number, lang, int(t.levels[0][2].sum()), None, *[None] * 4)
            whole[lang] = t.pruned(least)
        fs, path = store.filesystem(name := f"{folder}/range-{number}-{uuid.uuid4().hex}")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as f:
            f.write(pickle.dumps({lang: t.dump() for lang, t in whole.items()}))
        yield (2, number, None, None, name, *[None] * 4)
        for lang, t in whole.items():
            yield from _questions(t, lang, splitters, least)

    def run(batches):
        now, parts = None, {}
        for batch in batches:
            for _, number, lang, body in zip(*(c.to_pylist() for c in batch.columns)):
                if now != number and parts:
                    yield from _rows(finish(now, parts))
                    parts = {}
                now = number
                mine = parts.setdefault(lang, [])
                mine.append(Transducer.load(body))
                if len(mine) >= 32:  # so that what is held is about as large as the union
                    parts[lang] = [Transducer.union(mine)]
        if parts:
            yield from _rows(finish(now, parts))

    return run


_UNION_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]


def _rows(rows):
    """Batches of SEND_ROWS rows at most."""
    while some := [*islice(rows, SEND_ROWS)]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), _UNION_TYPES)], names=[c.split()[0] for c in _UNION.split(", ")])


def _questions(t: Transducer, lang: str, splitters: list[np.ndarray], least: int):
    """For each candidate and cut, the part before (side 0) and after it (1), with the range to be asked; and the words of the range."""
    held = np.concatenate([np.zeros(1, _U), t.digests])
    for label, weight in zip(t.levels[0][1].tolist(), t.levels[0][2].tolist()):
        if weight >= least:
            yield (4, 0, lang, None, t.words[label - 1].decode(), held[label].tobytes(), None, None, None)
    for n in range(2, LONGEST + 1):
        arcs = np.flatnonzero(t.levels[n - 1][2] >= least)
        if not len(arcs):
            continue
        grams, weights = t.grams(n, arcs), t.levels[n - 1][2][arcs].tolist()
        phrases = [row.tobytes() for row in held[grams]]
        for k in range(1, n):
            for side, (a, b) in enumerate(((0, k), (k, n))):
                part = np.zeros((len(arcs), LONGEST), np.int64)
                part[:, : b - a] = grams[:, a:b]
                for r, w, phrase in zip(_ranges_of(_columns(t.digests, part), splitters).tolist(), weights, phrases):
                    yield (3, r, lang, w, None, phrase, k, side, phrase[8 * a : 8 * b])


def _answers(batches):
    """f of every question, by the transducer of its range; a partition's questions come in the order of ranges."""
    held: tuple[str | None, dict] = (None, {})
    for batch in batches:
        path, lang, part = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        found, at = np.zeros(len(batch), np.int64), 0
        while at < len(batch):
            end = at + 1
            while end < len(batch) and path[end] == path[at] and lang[end] == lang[at]:
                end += 1
            if held[0] != path[at]:
                fs, file = store.filesystem(path[at])
                with fs.open_input_stream(file) as f:
                    held = (path[at], {k: Transducer.load(v) for k, v in pickle.loads(f.read()).items()})
            digests = np.frombuffer(b"".join(p.ljust(8 * (LONGEST - 1), b"\0") for p in part[at:end]), _U).reshape(-1, LONGEST - 1)
            found[at:end] = held[1][lang[at]].weights_of(digests)
            at = end
        yield pa.RecordBatch.from_arrays([batch.column(1), *batch.columns[3:], pa.array(found)], names=["lang", "phrase", "a", "k", "side", "f"])


def _score(a: Column, parts: Column, scale: int = 2_000_000) -> Column:
    """scale * a / parts, rounded down, without passing 64 bits on the way."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(scale).cast("decimal(19,0)") * wide(a), wide(parts)).cast("long")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases.

    A phrase's score is that of its worst cut. Those inside a longer candidate with at least ``share``
    per cent of their occurrences are left out.
    """
    spark = docs.sparkSession
    rows = store.small_batches(docs).select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    splitters = _splitters(rows, size)
    ranges, folder = len(splitters[0]) + 1, store.shared_dir(spark, "transducers")
    parts = rows.mapInArrow(_shard(splitters), _PARTS).repartitionById(min(ranges, 10_000), F.col("range") % min(ranges, 10_000)).sortWithinPartitions("range")
    united = store.materialise(parts.mapInArrow(_union(splitters, least, folder), _UNION), "united")
    files = united.where("kind = 2").select("range", F.col("name").alias("path"))
    asked = united.where("kind = 3").join(files, "range").select("path", "lang", "part", "phrase", F.col("n").alias("a"), "k", "side")
    # Ranges of rows and not of keys: a part of very many phrases is asked for in several tasks.
    dealt = asked.repartitionByRange("path", "lang", F.xxhash64("phrase", "k")).sortWithinPartitions("path", "lang")
    answers = dealt.mapInArrow(_answers, "lang string, phrase binary, a long, k int, side int, f long")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("f")))
    cuts = answers.groupBy("lang", "phrase", "a", "k").agg(of(0).alias("l"), of(1).alias("r"))
    scored = cuts.withColumn("score", _score(F.col("a"), F.col("l") + F.col("r")))
    best = store.materialise(_named(scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")), united.where("kind = 4")), "scored")
    inner = _inner(best).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    hundred = lambda c, x: F.col(c).cast("decimal(19,0)") * x
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (hundred("longer", 100) < hundred("a", share)))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    n = united.where("kind = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def _named(best: DataFrame, words: DataFrame) -> DataFrame:
    """Phrases as words in the place of their digests."""
    digests = F.transform(F.sequence(F.lit(0), (F.octet_length("phrase") / 8).cast("int") - 1), lambda i: F.substring(F.col("phrase"), 8 * i + 1, F.lit(8)))
    each = best.select("lang", "phrase", "a", "cut", F.posexplode(digests).alias("at", "digest"))
    named = each.join(words.select("lang", F.col("phrase").alias("digest"), "name"), ["lang", "digest"])
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), " ")
    return named.groupBy("lang", "phrase", "a", "cut").agg(whole.alias("words")).select("lang", F.col("words").alias("phrase"), "a", "cut")


def _inner(best: DataFrame) -> DataFrame:
    """lang, phrase, longer: every shorter phrase of two words or more inside a candidate, with the candidate's count."""
    def inside(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("words") - n + 1)
        return F.when(F.size("words") > n, F.transform(starts, lambda i: F.array_join(F.slice("words", i, n), " "))).otherwise(F.array().cast("array<string>"))

    found = best.select("lang", F.col("a").alias("longer"), F.split("phrase", " ", -1).alias("words"))
    return found.select("lang", "longer", F.explode(F.concat(*map(inside, range(2, LONGEST)))).alias("phrase"))
