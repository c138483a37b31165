"""Suffix automata, count transducers and lexical search against brute force."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("xxhash")

from sightline.llm import automata, collocations, lexical, suffixes  # noqa: E402

SPACE = re.compile("[^\x20\x09-\x0d]+")


def text_of(r, n, letters="abcdé"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 3))) for _ in range(n))


def copies(seed):
    """Texts with common passages in many contexts, near copies, periods, ties, blanks, nulls and repeated rows."""
    r = random.Random(seed)
    base, passage, out = text_of(r, 400), text_of(r, 70), []
    for i in range(40):
        w = base.split(" ")
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = "x" + str(i)
        out.append(" ".join(w[r.randint(0, 50) :]))
    out += [text_of(r, r.randint(0, 60)) + " " + passage + "\n" + text_of(r, r.randint(0, 60)) for _ in range(40)]
    out += ["a " * 300, "a\tb " * 120, "", None, " \n ", base, base, text_of(r, 49), passage + " " + passage, base.upper()]
    rows = [(i if i % 13 else (None if i % 2 else 3), t, "x") for i, t in enumerate(out)]
    r.shuffle(rows)
    return rows + rows[:3]


def brute_cut(rows, length):
    first = {}
    each = [(i, SPACE.findall(t or "")) for i, t, _ in rows]
    for i, w in each:
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            if i is not None and i < first.get(key, i + 1):
                first[key] = i
    for i, w in each:
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - length + 1):
            if i is not None and first[tuple(w[s : s + length])] < i:
                gone[s : s + length] = True
        kept = [x for x, g in zip(w, gone) if not g]
        yield i, len(w), int(gone.sum()), hashlib.sha256(" ".join(kept).encode()).hexdigest()


@pytest.mark.parametrize("length, shard, segment", [(50, 100_000, None), (50, 300, None), (20, 50, 200)])
def test_passages_of_earlier_documents(spark, monkeypatch, length, shard, segment):
    monkeypatch.setattr(automata, "SHARD_WORDS", shard)
    if segment:
        for module in (automata, suffixes):
            monkeypatch.setattr(module, "SEGMENT", segment)
    rows = copies(length + shard)
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string").repartition(5)
    got = sorted(map(tuple, automata.remove_earlier(df, length, digest=True).collect()), key=str)
    assert got == sorted(brute_cut(rows, length), key=str)
    assert automata.remove_earlier(df.limit(0)).count() == 0


def test_windows_of_a_suffix_automaton():
    r = random.Random(1)
    sequences = [[r.randrange(3) for _ in range(r.randint(1, 40))] for _ in range(30)]
    ids = [r.randrange(20) for _ in sequences]
    a = automata.SuffixAutomaton(sequences, ids)
    for asked in sequences + [[r.randrange(4) for _ in range(30)]]:
        for length in (1, 3, 5):
            found = [min((i for s, i in zip(sequences, ids) if any(s[k : k + length] == asked[j : j + length] for k in range(len(s)))), default=None) for j in range(len(asked) - length + 1)]
            assert a.first_of_windows(asked, length) == found


def test_contexts_of_a_common_passage_are_not_sent_on(spark, monkeypatch):
    r = random.Random(5)
    long_word = lambda: "".join(r.choice("abcdefgh") for _ in range(9))
    passage = " ".join(long_word() for _ in range(60))
    rows = [(i, " ".join(long_word() for _ in range(40)) + " " + passage + " " + " ".join(long_word() for _ in range(40))) for i in range(300)]
    sizes, whole = {}, automata.store.materialise

    def counting(df, name):
        out = whole(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(automata.store, "materialise", counting)
    out = automata.remove_earlier(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(x.n_removed == (60 if x.doc_id else 0) for x in out)
    assert sizes["contents"] > 600 and sizes["going"] == 11


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_phrases(rows, least, top, share):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang in f:
        g, out = f[lang], []
        large = {p: a for p, a in g.items() if len(p) > 1 and a >= least}
        for p, a in large.items():
            if any(100 * b >= share * a for q, b in large.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            score, k = min((2_000_000 * a // (g[p[:k]] + g[p[k:]]), k) for k in range(1, len(p)))
            out.append((-score, -a, " ".join(p).encode(), g[p[:k]], g[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(out)[:top], 1):
            yield lang, rank, p.decode(), -a, left, right, n[lang], -s


@pytest.mark.parametrize("block, size, words", [(1_000_000, 8_000_000, 0xFFFF), (50, 3000, 0xFFFF), (400, 900, 30)])
def test_collocations(spark, monkeypatch, block, size, words):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block)
    monkeypatch.setattr(collocations, "RANGE_BYTES", size)
    monkeypatch.setattr(collocations, "MOST_WORDS", words)
    r = random.Random(size)
    vocabulary = [text_of(r, 1, "abcé") for _ in range(12)]
    rows = [(i, " ".join(r.choice(vocabulary) + r.choice(["", "", "", ".", ",\t", "\r\n", "\x0b"]) for _ in range(r.randint(0, 120))), [None, "en", "de", "und"][i % 4]) for i in range(60)]
    rows += [(1, None, "en"), (None, "", None), (2, "the same. " * 400, "zz"), (2, "A B\tC d " * 90, "zz"), (3, "é É x " * 40, "zz")]
    df = spark.createDataFrame(rows, "n long, text string, lang string").repartition(3)
    got = sorted(map(tuple, collocations.collocations(df, 30, 40).collect()))
    assert got == sorted(brute_phrases(rows, 30, 40, 80))
    assert collocations.collocations(df.limit(0)).count() == 0


def test_blocks_of_waiting_languages_take_little_memory():
    r = np.random.default_rng(3)
    vocabulary = np.array([text_of(random.Random(i), 3).replace(" ", "") + str(i) for i in range(5000)])
    texts = [" ".join(vocabulary[r.integers(0, 5000, 1000)]) for _ in range(800)]
    batches = [pa.RecordBatch.from_arrays([pa.array([f"l{i % 4}" for i in range(100)]), pa.array(texts[at : at + 100])], names=["lang", "text"]) for at in range(0, 800, 100)]
    cuts = [np.sort(r.integers(-(2**63), 2**63, 31)), *[np.full(31, -(2**63), np.int64)] * 3]
    tracemalloc.start()
    parts = sum(len(b) for b in collocations._shard(cuts)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert parts > 100
    assert peak < 60_000_000  # 800,000 words wait, and a quarter of them is counted at a time


def test_one_long_text_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 7)
    monkeypatch.setattr(collocations, "SEND_ROWS", 2)
    monkeypatch.setattr(collocations, "SLICE", 3)
    rows = [(1, "a b c d e. " * 40 + "a b c " * 60, "en"), (2, "x y " * 50, "en"), (3, "", None)]
    got = sorted(map(tuple, collocations.collocations(spark.createDataFrame(rows, "n long, text string, lang string"), 30, 40).collect()))
    assert got == sorted(brute_phrases(rows, 30, 40, 80))


@pytest.mark.parametrize("seed", range(3))
def test_cuts_are_where_digests_say(seed):
    r = np.random.default_rng(seed)
    digests = np.sort(r.integers(1, 40, 12).astype(np.uint64) << np.uint64(58) | r.integers(0, 99, 12).astype(np.uint64))
    digests = np.unique(digests)
    grams = np.unique(np.array([[*r.integers(1, len(digests) + 1, k), *[0] * (4 - k)] for k in r.integers(1, 5, 60)]), axis=0).astype(np.uint64)
    keys = sum(grams[:, i] << np.uint64(48 - 16 * i) for i in range(4))
    columns = collocations._columns(digests, collocations._rows_of(keys))
    cuts = np.array([[c[i] for c in columns] for i in r.integers(0, len(keys), 10)] + [[*r.integers(-(2**63), 2**63, k), *[-(2**63)] * (4 - k)] for k in (1, 2, 3, 4)])
    cuts[-1, 0] = columns[0][-1]
    splitters = [np.ascontiguousarray(c) for c in cuts[np.lexsort(cuts.T[::-1])].T]
    assert (collocations._cuts(splitters, digests, keys) == suffixes.bucket_of(splitters, columns)).all()


def test_scores_pass_64_bits(spark):
    a = 10**15 * 9
    row = spark.range(1).select(collocations._score(*map(__import__("pyspark").sql.functions.lit, (a, 10**16 * 9)))).first()[0]
    assert row == 2_000_000 * a // (10**16 * 9)


WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_search(docs, items, k):
    words = [[w.translate(LOWER) for w in WORD.findall(t or "")] for _, t in docs]
    held = [(d[0], Counter(w), len(w)) for d, w in zip(docs, words) if w]
    n, total, df = len(held), sum(x[2] for x in held), Counter(t for x in held for t in x[1])
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= {w.translate(LOWER) for w in WORD.findall(t or "")}
    for i, terms in asked.items():
        scored = []
        for doc, tf, size in held:
            m = 10 + (90 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if s > 0:
                scored.append((-s, -1 if doc is None else doc))
        for rank, (s, doc) in enumerate(sorted(scored)[:k], 1):
            yield i, rank, None if doc < 0 else doc, -s


@pytest.mark.parametrize("docs_each, sample, block, front", [(16_384, 8192, 200_000, 128), (7, 20, 200_000, 2), (30, 50, 10, 1)])
def test_search(spark, monkeypatch, docs_each, sample, block, front):
    for name, value in (("SHARD_DOCS", docs_each), ("SAMPLE_DOCS", sample), ("BLOCK_TERMS", block), ("FRONT", front)):
        monkeypatch.setattr(lexical, name, value)
    r = random.Random(docs_each)
    docs = [(i % 140 if i % 29 else None, " ".join(text_of(r, 1, "abcdÉ9") for _ in range(r.randint(0, 30))) + r.choice(["", "-", " A_b"])) for i in range(200)]
    docs += [(5, None), (6, ""), (7, "..."), *docs[:4], (8, "a b " * 4000)]
    items = [(f"i{i}", text_of(r, r.randint(1, 9), "abcdÉ9")) for i in range(12)] + [("i0", "a b"), ("none", None), ("blank", " "), ("far", "zzzzz"), (None, "B c")]
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    right = spark.createDataFrame(items, "item_id string, text string")
    got = lexical.search(left, right)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_search(docs, items, 10), key=str)
    assert lexical.search(left.limit(0), right).count() == 0 and lexical.search(left, right.limit(0)).count() == 0


def test_search_looks_at_few_documents():
    """With one document that has all terms, bounds end the work early."""
    r = np.random.default_rng(2)
    n = 4000
    terms = [np.unique(r.integers(0, 400, 12)).astype(np.int32) for _ in range(n)]
    for i in range(10):
        terms[i * 300] = np.unique(np.concatenate([terms[i * 300], np.arange(20, dtype=np.int32)]))
    index = lexical.Postings(np.full(n, 30), [t.tobytes() for t in terms], [np.ones(len(t), np.int32).tobytes() for t in terms], n, 30 * n)
    docs, scores = index.search(np.arange(20), np.full(20, 5000, np.int64), 10, 1)
    assert set(docs[np.argsort(-scores)[:10]]) == {i * 300 for i in range(10)} and len(docs) < n / 4
