"""SimHash, suffix removal and decontamination against brute force."""

import hashlib
import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("xxhash")

from sightline.llm import decontaminate, simhash, suffixes  # noqa: E402
from sightline.llm.components import connected_components  # noqa: E402


def words(r, n):
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 8))) for _ in range(n))


def corpus(seed=3):
    r = random.Random(seed)
    base, out = words(r, 300), []
    for _ in range(60):
        w = base.split(" ")
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = words(r, 1)
        out.append(" ".join(w))
    p, q = words(r, 75), words(r, 95)
    out += [words(r, r.randint(0, 120)) + " " + (p if i % 2 else q) + " " + words(r, r.randint(0, 80)) for i in range(40)]
    out += ["a" * 1500, "ab" * 700, "a" * 399, "a" * 400, "", None, base, base, words(r, 400) * 2, " \t", "One", "one"]
    rows = [(i if i % 50 else None, d, "x", 1) for i, d in enumerate(out)]
    return rows + [rows[7], rows[0]]


SCHEMA = "doc_id long, text string, fingerprint string, mark long"


def brute_cut(rows, length):
    seen = defaultdict(int)
    for r in rows:
        b = (r[1] or "").encode()
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] += 1
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s] += 1
                gone[s + length] -= 1
        cover = np.cumsum(gone)[: len(b)] > 0
        yield r[0], len(b), int(cover.sum()), int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~cover].tobytes()).hexdigest()


@pytest.mark.parametrize("length, parts, segment", [(400, 5, None), (400, 13, 2000), (300, 1, 700)])
def test_suffix_removal(spark, monkeypatch, length, parts, segment):
    if segment:
        monkeypatch.setattr(suffixes, "SEGMENT", segment)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = sorted(map(tuple, suffixes.repeat_report(df, length).collect()), key=str)
    assert got == sorted(brute_cut(rows, length), key=str)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="no tables")
def test_suffix_removal_of_a_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, suffixes.repeat_report(df).collect()), key=str) == sorted(brute_cut(df.collect(), 400), key=str)


def test_rare_repeats_use_all_buckets(spark, monkeypatch):
    """Six of many documents share long passages, a sample of all documents would hold none of them: windows are dealt all the same."""
    monkeypatch.setattr(suffixes, "SAMPLE_DOCS", 20)
    r = random.Random(11)
    letters = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = letters(900)
    rows = [(i, letters(450)) for i in range(1500)]
    for i in range(6):
        rows[i * 240] = (i * 240, letters(200 + 31 * i) + shared[: 860 + i] + letters(300))
    dealt, windows = [], suffixes._windows

    def seen(length, of_words, splitters=None):
        dealt.append(splitters)
        return windows(length, of_words, splitters)

    monkeypatch.setattr(suffixes, "_windows", seen)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = sorted(map(tuple, suffixes.repeat_report(df, 400).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == sorted(brute_cut(rows, 400), key=str) and sum(x[2] > 0 for x in got) == 6
    cuts = dealt[-1]
    assert (cuts == 16 or len(set(zip(*[c.tolist() for c in cuts]))) > 8)


def test_rows_are_dealt_by_digest_without_splitters():
    import pyarrow as pa

    r = np.random.default_rng(1)
    keys = [r.integers(-(2**60), 2**60, 4000) for _ in range(4)]
    keys[0][::2], keys[1][::2], keys[2][::2] = keys[0][1::2], keys[1][1::2], keys[2][1::2]
    other = [pa.array(np.zeros(4000, np.int64))] * 3
    bucket = suffixes._dealt([*map(pa.array, keys), *other], 16, suffixes._WINDOWS, 3).column(7).to_numpy()
    assert (bucket[::2] == bucket[1::2]).all() and np.bincount(bucket, minlength=16).min() > 150


def test_buckets_follow_the_order_of_all_keys():
    r = np.random.default_rng(4)
    keys = [r.integers(0, 3, 300) for _ in range(4)]
    cuts = sorted(zip(*[r.integers(0, 3, 9).tolist() for _ in range(4)]))
    got = suffixes.bucket_of(keys, [np.array(c) for c in zip(*cuts)])
    assert got.tolist() == [sum(c <= row for c in cuts) for row in zip(*(k.tolist() for k in keys))]


def test_multikey_sort():
    r = np.random.default_rng(0)
    keys = [r.integers(0, 3, 200).astype(np.int64) for _ in range(3)]
    order, depths = suffixes.multikey_sort(keys)
    rows = list(zip(*[k[order] for k in keys]))
    assert rows == sorted(rows)
    assert [a == b for a, b in zip(rows, rows[1:])] == (np.diff(depths[-1]) == 0).tolist()


def brute_fingerprint(text, size):
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    hs = [xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("unit", [4096, 20])
def test_simhash(spark, monkeypatch, unit):
    monkeypatch.setattr(simhash, "UNIT", unit)
    rows = corpus()
    prints = [brute_fingerprint(r[1], 4) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    lows = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            lows[find(i)].append(r[0])
    want = sorted(((r[0], prints[i], min(lows[find(i)], default=None)) for i, r in enumerate(rows)), key=str)
    got = sorted(((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == want


def test_gray_index_finds_what_all_pairs_do():
    r = np.random.default_rng(1)
    centre = r.integers(0, 2**63, 6).astype(np.uint64)
    codes = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (150, 4)).astype(np.uint64), axis=1) for c in centre]))
    for radius in (0, 2, 4):
        a, b = (codes[x] for x in simhash.GrayIndex(codes[:, None]).links(radius))
        up = {int(c): int(c) for c in codes}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for x in codes.tolist():
            for y in codes.tolist():
                if (x ^ y).bit_count() <= radius:
                    up[find(x)] = find(y)
        groups = defaultdict(set)
        for x in codes.tolist():
            groups[find(x)].add(x)
        mine = defaultdict(set)
        root = dict(zip(a.tolist(), b.tolist()))
        for x in codes.tolist():
            mine[root.get(x, x)].add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, i) for i in range(101, 140)] + [(7, 7)], "a long, b long")
    got = dict(map(tuple, connected_components(edges).collect()))
    assert all(got[i] == i // 20 * 20 for i in range(60)) and all(got[i] == 100 for i in range(101, 140)) and got[100] == 100
    assert connected_components(edges.limit(0)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(docs, items, n=10):
    wins = defaultdict(set)
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            wins[tuple(w[i : i + n])].add(item)
    for doc, text, *_ in docs:
        w, hit, found = split(text), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    found |= {str(x) for x in wins[tuple(w[i : i + k])] if x is not None}
        yield doc, len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [50_000, 7])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    r = random.Random(5)
    items = [(i, words(r, r.randint(8, 25))) for i in range(12)] + [(20, "Ä kurz Ende"), (21, ""), (22, None), (23, "x x x x x x x x x x x"), (None, "ohne nummer hier"), (20, "zweimal gleich id"), (100, "Ä kurz Ende")]
    docs = []
    for i in range(60):
        text = words(r, r.randint(0, 60))
        if i % 3 == 0:
            w = (items[i % 12][1] or "").split()
            text += ". " + ", ".join(w[r.randint(0, 3) :]).upper() + " " + words(r, 5)
        docs.append((i if i % 20 else None, text, "x", 1))
    docs += [(70, "ä KURZ ende und Ä kurz Ende", "x", 1), (71, None, "x", 1), (72, "", "x", 1), (73, "x " * 30, "x", 1), (74, "ohne nummer hier, zweimal gleich ID", "x", 1)]
    docs += docs[:2]
    d = spark.createDataFrame(docs, "doc_id long, text string, words string, row long").repartition(4)
    got = decontaminate.contamination(d, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_hits(docs, items), key=str)
    assert decontaminate.contamination(d, spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(d.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    clean = decontaminate.keep_clean(d, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.count() == sum(x[2] == 0 for x in brute_hits(docs, items)) and clean.columns == d.columns


def test_decontamination_is_native(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = decontaminate.contamination(d, d.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffixes.repeat_report(none).count() == 0 and simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(spark.createDataFrame([(1, "a", "", 1), (1, "a", "", 1), (None, "a", "", 1)], SCHEMA)).select(F.col("doc_id")).count() == 2


def test_different_texts_with_one_id_are_different_documents(spark):
    kept = simhash.keep_one(spark.createDataFrame([(1, "a b c d e f", "", 1), (1, "g h i j k l", "", 1), (1, "a b c d e f", "", 1), (2, "g h i j k l", "", 1), (3, None, "", 1)], SCHEMA))
    assert sorted((x.doc_id, x.text or "") for x in kept.collect()) == [(1, "a b c d e f"), (1, "g h i j k l"), (3, "")]


def test_near_copies_in_groups_of_many_parts(spark, monkeypatch):
    """A cluster whose copies are near the first text and not each other, in parts, against all pairs."""
    monkeypatch.setattr(simhash, "UNIT", 16)
    monkeypatch.setattr(simhash, "GRAMS", 3000)
    r = random.Random(21)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        w = base[:]
        for at in r.sample(range(150), r.randint(1, 5)):
            w[at] = f"x{i}y{at}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and up[i] != up[j]:
                up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert kept == {i for i in range(len(rows)) if up[i] == i}


def test_near_copies_of_a_similarity_of_four_fifths_go(spark):
    r = random.Random(9)
    vocabulary = [words(r, 1) + str(i) for i in range(3000)]
    rows, near = [], []
    for i in range(40):
        base = [r.choice(vocabulary) for _ in range(400)]
        rows.append((2 * i, " ".join(base)))
        changed = base[:]
        for at in r.sample(range(20, 380), 5):  # up to 25 of 396 shingles
            changed[at] = r.choice(vocabulary)
        near.append(2 * i + 1)
        rows.append((2 * i + 1, " ".join(changed)))
    rows += [(1000 + i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 50)))) for i in range(60)] + [(2000, ""), (2001, None), (2002, "")]
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept & {*near} == set() and {2 * i for i in range(40)} <= kept and {1000 + i for i in range(60)} <= kept and kept & {2000, 2001, 2002} == {2000}


def test_links_are_exact_around_four_fifths(spark):
    r = random.Random(12)
    rows, near, apart = [], set(), set()
    for i in range(120):  # n words that start alike: n - 4 shingles, of which a changed tail takes as many as it has words
        n = r.choice([30, 104, 404])
        share = (0.78, 0.80, 0.82)[i % 3]
        tail = next(t for t in range(n) if (n - 4 - t) <= share * (n - 4 + t)) if share < 0.8 else max(t for t in range(n) if (n - 4 - t) >= share * (n - 4 + t))
        base = [f"w{r.randrange(10**9)}" for _ in range(n)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[: n - tail] + [f"v{r.randrange(10**9)}" for _ in range(tail)]))]
        (apart if share < 0.8 else near).add(2 * i + 1)
    rows += [(1000, "a b c d e " * 200 + "f"), (1001, "a b c d e f")]  # shingles of one are a few of the other's, in other numbers
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert kept & near == set() and apart <= kept and {2 * i for i in range(120)} | {1000, 1001} <= kept
