"""Token records, counts, packing and archives against the libraries and plain Python."""

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from sightline.llm import packing, records, store, token_counts, tokens, warc  # noqa: E402

BPE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = [
    "", " ", "  a  b", "a \n b", "x\n\n  y ", "<|endoftext|> hi", "foo<|endoftext|>bar", "a  ", "\n", "\n ", " \n", "日本 語  é É", "a   b", "don't  we'll I'M", "tab\t x", " \t x　 y", "ΑΣ ΣΑΣ İx ŉ", "é ́ x",
    "a <|ENDOFTEXT|> b", "x" * 3000 + " y." * 900, "wow!!! (yes)... «no»... é!", "a.b, c; 12.5% x_1", None]
DOCS = "doc_id long, text string, start long, n_tokens string, shard string"


def docs(spark):
    rows = [(i if i != 4 else None, t, 1, "x", "y") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + rows[:2], DOCS)


def ids(path, text):
    return tokens.encoder(path, path == BPE).whole([text or ""])[0]


@pytest.mark.parametrize("path", [BPE, WORD])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("aé .,!'\n\t<|endofx>1", max_size=40)), min_size=1, max_size=6))
def test_chunks_give_the_librarys_ids(path, texts):
    e = tokens.Encoder(path, path == BPE)
    arr = pa.array(texts, pa.large_string())
    flat, ends = e.encode(arr)
    want = e.whole(texts)
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [w.tolist() for w in want]
    assert e.count(arr).tolist() == [len(w) for w in want]


def test_records_round_trip(spark):
    folder = store.shared_dir(spark, "t")
    manifest = records.write_token_records(docs(spark), BPE, 2, folder)
    got = sorted(map(tuple, records.token_record_digests(manifest).collect()), key=lambda r: r[1])
    start, by_id = 0, {}
    for r in docs(spark).collect():
        by_id.setdefault(r.doc_id, np.append(ids(BPE, r.text), np.uint32(2)))
    for doc_id, at, n, crc in got:
        want = by_id[doc_id]
        assert (at, n, crc) == (start, len(want), zlib.crc32(want.astype("<u4").tobytes()))
        start += n
    assert [g[0] for g in got] == sorted((r.doc_id for r in docs(spark).collect()), key=lambda x: -1 if x is None else x)


def test_damage_is_seen():
    data = records.frame(b"abc") + records.frame(b"")
    assert records.unframe(data, 0) == b"abc"
    with pytest.raises(ValueError):
        records.unframe(data[:13] + b"X" + data[14:], 0)


def test_counts_and_cache(spark):
    cache = store.shared_dir(spark, "cache")
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(ids(WORD, r.text))) for r in docs(spark).collect()), key=str)
    for _ in range(2):  # the second time nothing is encoded
        got = sorted(map(tuple, token_counts.count_tokens(docs(spark), WORD, cache).collect()), key=str)
        assert got == want
        n = spark.read.schema(token_counts.CACHE).parquet(cache).count()
        assert n == len({" ".join((t or "").split()) if (t or "").isascii() else t for t in ODD}) or n <= len(ODD)
    assert spark.read.schema(token_counts.CACHE).parquet(cache).count() == n


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=200), st.sampled_from([(4096, 2048), (20, 8), (1, 0)]))
def test_packer_leaves_no_padding(lengths, pool):
    """With small pools sequences are filled while documents come in, too."""
    with pytest.MonkeyPatch.context() as m:
        m.setattr(packing, "POOL", pool[0])
        m.setattr(packing, "LOW", pool[1])
        check_packer(lengths)


def check_packer(lengths):
    p = packing.SlackPacker(64)
    for i, n in enumerate(lengths):
        p.add(i, n)
    p.close()
    seen, fill = {}, {}
    for (doc, start, n), seq, offset in p.out:
        assert fill.get(seq, 0) == offset
        fill[seq] = offset + n
        seen.setdefault(doc, []).append((start, n))
    for doc, parts in seen.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == lengths[doc]
    assert all(f <= 64 and f & (f - 1) == 0 for f in fill.values())


def test_best_fill_is_best():
    import itertools

    for counts, room in (({5: 2, 7: 1, 11: 3}, 20), ({3: 1}, 2), ({4: 5}, 17), ({9: 1, 6: 1, 5: 1, 4: 1}, 14)):
        items = [n for n, c in counts.items() for _ in range(c)]
        best = max(sum(s) for k in range(len(items) + 1) for s in itertools.combinations(items, k) if sum(s) <= room)
        taken = packing.best_fill(dict(counts), sum(1 << n for n in counts), room)
        assert sum(n * c for n, c in taken.items()) == best and all(c <= counts[n] for n, c in taken.items())


def test_pack(spark):
    got = packing.pack(docs(spark), BPE, 1, 64).collect()
    total = sum(len(ids(BPE, r.text)) + 1 for r in docs(spark).collect())
    assert sum(r.length for r in got) == total
    by_id = {r.doc_id: np.append(ids(BPE, r.text), np.uint32(1)) for r in docs(spark).collect()}
    for r in got:
        w = by_id[r.doc_id]
        assert r.doc_tokens == len(w) and r.ids_crc32 == zlib.crc32(w[r.start : r.start + r.length].astype("<u4").tobytes())


def test_archives(spark):
    rows = [(3, "u", "<p>é", "x"), (1, "u", "<p>é", "x"), (2, None, None, "x"), (4, "a\nb", "", "x"), (None, "v", "<p>é", "x"), (1, "u", "<p>é", "x"), (9, "w", "z" * 100_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string")
    got = sorted(map(tuple, warc.read_archives(warc.write_archives(pages, store.shared_dir(spark, "w"))).collect()), key=str)
    first = {"<p>é": 1, "": 2, "z" * 100_000: 9}
    want = []
    for page, _, html, _ in rows:
        html = html or ""
        revisit = page is not None and page > first[html]
        want.append((page, len(html.encode()), base64.b32encode(hashlib.sha1(html.encode()).digest()).decode(), "revisit" if revisit else "response", first[html] if revisit else None))
    assert got == sorted(want, key=str)


def test_empty_tables(spark):
    none = docs(spark).limit(0)
    assert records.token_record_digests(records.write_token_records(none, BPE, 2, store.shared_dir(spark, "e"))).count() == 0
    assert token_counts.count_tokens(none, WORD, store.shared_dir(spark, "e")).count() == 0
    assert packing.pack(none, BPE, 1).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages, store.shared_dir(spark, "e"))).count() == 0
