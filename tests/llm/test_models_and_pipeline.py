"""The classifier, the block labeller, neighbours and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("xxhash")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from sightline.llm import mainhtml, neighbours, quality, store  # noqa: E402
from tests.llm.test_duplicates import brute_hits, words  # noqa: E402


def test_net_learns_and_its_gradient_is_right():
    r = random.Random(1)
    good = [words(r, r.randint(5, 200)) for _ in range(120)]
    bad = [w.replace(" ", "!!! ") for w in (words(r, r.randint(5, 200)) for _ in range(120))]
    net = quality.ByteConvNet().fit([*map(str.encode, good + bad)], np.array([1.0] * 120 + [0.0] * 120))
    score = net.predict([*map(str.encode, [words(r, 50), words(r, 50).replace(" ", "!!! "), ""])])
    assert score[0] > 0.7 > 0.3 > score[1] and 0 <= score[2] <= 1
    texts, y = [b"abc" * 300, b"x", b""], np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.sum(y * np.log(p := net.predict(texts)) + (1 - y) * np.log(1 - p)) / 3
    g = net._gradient(texts, y)
    for name, at in (("out", 3), ("shift", 0), ("bias", 2)):
        base = net.p[name][at]
        up, down = [(net.p[name].__setitem__(at, base + e), loss())[1] for e in (1e-2, -1e-2)]
        net.p[name][at] = base
        assert abs((up - down) / 2e-2 - g[name][at]) < 2e-3


def test_a_long_text_scores_as_its_parts_do():
    net = quality.ByteConvNet()
    data = bytes(random.Random(2).randrange(1, 256) for _ in range(3 * quality.SPAN + 77))
    whole, halves = quality.padded([data])
    at_once = net._conv(whole, len(whole) - quality.WIDTH + 1).max(1)
    assert np.allclose(net._halves(whole), at_once) and halves[0] == len(at_once)


def test_scores_equal_those_of_loops():
    """The same formula byte by byte: filters at each place, the largest of each chunk, mean and largest of chunks."""
    net, r = quality.ByteConvNet(), random.Random(5)
    net.p["bias"] += np.float32(0.2)
    for n in (0, 1, 3, 253, 254, 256, 700, 1500):
        text = bytes(r.randrange(1, 256) for _ in range(n))
        size = -(-(n + quality.WIDTH - 1) // quality.HALF) * quality.HALF
        data = text.ljust(size + quality.WIDTH - 1, b"\0")
        places = [[sum(float(net.p["table"][j][data[at + j]][f]) for j in range(quality.WIDTH)) for f in range(quality.FILTERS)] for at in range(size)]
        halves = [[max(p[f] for p in places[at : at + quality.HALF]) for f in range(quality.FILTERS)] for at in range(0, size, quality.HALF)]
        chunks = [list(map(max, zip(a, b))) for a, b in zip(halves, halves[1:])] or halves
        live = [[max(0.0, x + float(b)) for x, b in zip(c, net.p["bias"])] for c in chunks]
        features = [sum(c) / len(live) for c in zip(*live)] + [max(c) for c in zip(*live)]
        want = 1 / (1 + np.exp(-sum(x * float(w) for x, w in zip(features, net.p["out"])) - float(net.p["shift"][0])))
        assert abs(net.predict([b"other", text])[1] - want) < 1e-5


def test_block_probabilities_equal_those_of_loops():
    """Both passes of the net step by step, one page at a time."""
    net = mainhtml.BlockLabeller()
    pages = [mainhtml.blocks_of(p) for p in ("<p>a b<div class='x y'>c <a href='/'>d</a></div><p>e", "", "<ul><li>f<li>g h i</ul>", "j")]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for blocks, got in zip(pages, net.probabilities(pages)):
        rows = []
        for b in blocks:
            path = np.mean([net.p["path"][i] for i in mainhtml._path_ids(b.path)], 0)
            word = np.mean([net.p["word"][zlib.crc32(w.encode()) % mainhtml.WORDS] for w in b.words], 0)
            rows.append(np.concatenate([path, word, [np.log1p(len(b.words)) / 4, b.linked, np.log1p(len(b.text)) / 6]]))
        states = {}
        for d, order in (("f", range(len(rows))), ("b", range(len(rows) - 1, -1, -1))):
            h = c = np.zeros(mainhtml.HIDDEN)
            for t in order:
                i, f, o, n = np.split(rows[t] @ net.p["w" + d] + h @ net.p["u" + d] + net.p["c" + d], 4)
                c = sigmoid(f) * c + sigmoid(i) * np.tanh(n)
                h = sigmoid(o) * np.tanh(c)
                states[d, t] = h
        want = [sigmoid(np.concatenate([states["f", t], states["b", t]]) @ net.p["out"] + net.p["shift"][0]) for t in range(len(rows))]
        assert len(got) == len(want) and np.allclose(got, want, atol=1e-5)


def test_variation_keeps_blocks_and_labels_together():
    rng = np.random.default_rng(2)
    for page in ('<body class="b"><nav>n</nav><article class="a>b" id=x><h1>t1 t2 t3 t4 t5 t6 t7</h1><p>u1 u2 u3 u4 u5 u6 u7</article><footer>f</footer></body>', "<body><nav>n</nav><main>p<p>q</main></body>", "<body><p>q</body>", "<p>no body", ""):
        for _ in range(20):
            shown, meant = mainhtml.varied(page, rng)
            a, b = mainhtml.blocks_of(shown), mainhtml.blocks_of(meant)
            assert [x.text for x in a] == [x.text for x in b] and all(not mainhtml.weak_label(x) for x in b if x.text in ("n", "f"))
            assert all(mainhtml.weak_label(x) for x in b if x.text in ("t1 t2 t3 t4 t5 t6 t7", "u1 u2 u3 u4 u5 u6 u7"))
    blocks, labels = mainhtml.examples(["<nav>n</nav><article><p>x</article>"] * 4)
    assert len(blocks) == 12 and all(len(b) == len(y) for b, y in zip(blocks, labels))
    assert mainhtml.BlockLabeller().fit(*mainhtml.examples([])).probabilities([[]])[0].size == 0


def quality_tables(spark):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(160):
        text = words(r, r.randint(20, 80))
        bad = i % 5 == 0
        docs.append((i, text.upper().replace(" ", "!! ") if bad else text, "en", "s", len(text)))
        labels.append((i, int(not bad), 0))
    docs += [(500, None, "en", "s", 0), (501, "", "en", "s", 0), (None, words(r, 30), "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(docs, schema), spark.createDataFrame(labels + [(9999, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_quality_on_spark(spark):
    docs, labels = quality_tables(spark)
    out = quality.score(docs, quality.learn(docs, labels)).withColumn("h", quality.held_out("doc_id")).collect()
    assert len(out) == 163 and all(0 <= x.score <= 1 for x in out)
    assert all(x.h == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in out)
    held = [x for x in out if x.h and x.doc_id < 160]
    assert sum((x.score >= 0.7) == (x.doc_id % 5 != 0) for x in held) >= 0.9 * len(held)
    none = docs.limit(0)
    assert quality.score(none, quality.learn(none, labels)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav><!-- no -->
<div class="ad">Buy {0}.</div><article><h1>Head {0}</h1><p><b>First {1} &amp; more<br><p>Second&nbsp; {2} wo<i>rd</i>s.</p></article><footer>&copy; x</footer></body></html>"""


def test_blocks_of_broken_markup():
    text = lambda page: [b.text for b in mainhtml.blocks_of(page)]
    assert text("") == [] and text("plain  text") == ["plain text"]
    assert text("<p>a<p>b<div>c &lt;d&gt;</div") == ["a", "b", "c <d>"] or text("<p>a<p>b<div>c &lt;d&gt;</div")[:2] == ["a", "b"]
    assert text("<p title=\"a>b\">x</p><script>if(a<b)</script>y<!-- z") == ["x", "y"]
    assert text("wo<b>rd</b><br>next") == ["word", "next"]
    assert text("<p title='>broken") != []


def test_main_text(spark):
    r = random.Random(6)
    rows = [(i, "u", PAGE.format(words(r, 3), words(r, 20), words(r, 30))) for i in range(60)] + [(60, None, None), (61, "v", ""), (5, "w", "<nav>x</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {(x.page_id, x.url): x.text for x in mainhtml.extract(pages, mainhtml.learn(pages)).collect()}
    right = 0
    for i, _, page in rows[:60]:
        body = page[page.index("<h1>") : page.index("</article>")]
        want = " ".join(body.replace("&amp;", "&").replace("&nbsp;", " ").replace("<i>", "").replace("</i>", "").replace("<h1>", " ").replace("</h1>", " ").replace("<p>", " ").replace("</p>", " ").replace("<b>", "").replace("<br>", " ").split())
        right += out[i, "u"] == want
    assert right >= 57 and out[60, None] == "" and out[61, "v"] == "" and len(out) == 63
    assert mainhtml.extract(pages.limit(0), mainhtml.learn(pages.limit(0))).count() == 0


def test_neighbours(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(600, 24)).astype(np.float32)
    v[300:320] = v[0]
    rows = [(i, x.tolist(), "z") for i, x in enumerate(v)]
    rows += [(700, [0.0] * 24, "z"), (800, None, "z"), (900, [float("nan")] + [1.0] * 23, "z"), (1000, [1.0] * 5, "z"), (None, v[1].tolist(), "z"), (100, v[100].tolist(), "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    got = {}
    for q, rank, i, s in map(tuple, neighbours.nearest(df, df.where("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect()):
        got.setdefault(q, []).append((i, s))
    assert sorted(got) == [0, 100, 200, 300, 400, 500]
    hit, x = 0, v.astype(np.float64)
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = sorted((d[i], i) for i in range(600) if i != q)[:10]
        hit += len({i for _, i in best} & {i for i, _ in found})
        assert all(abs(d[i] - s) < 1e-12 for i, s in found) and found == sorted(found, key=lambda y: (y[1], y[0]))
    assert hit >= 0.9 * 60 and [i for i, _ in got[0]] == list(range(300, 310))
    assert neighbours.nearest(df.limit(0), df, 10).count() == 0


def test_neighbours_of_odd_tables(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(599, 16)).astype(np.float32)
    rows = [(0, [1.0] * 5), *((i + 1, x.tolist()) for i, x in enumerate(v))]  # a vector of another dimension comes first
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    found = neighbours.nearest(df, df.where("vec_id % 100 = 0")).collect()
    assert sorted({x.query_id for x in found}) == [100, 200, 300, 400, 500] and len(found) == 50
    # Queries far from all others and from each other still get all candidates that there are.
    few = spark.createDataFrame([(100 * i, (x * 10.0 ** (i % 5)).tolist()) for i, x in enumerate(v[:7])], "vec_id long, embedding array<float>")
    assert sorted((x.query_id, x.rank) for x in neighbours.nearest(few, few).collect()) == [(100 * i, n) for i in range(7) for n in range(1, 7)]


def test_probing_finds_all_codes_within_a_radius_and_few_others():
    r = np.random.default_rng(4)
    v = r.normal(size=(900, 32))
    v[450:] = v[:450] + r.normal(size=(450, 32)) * 0.4
    index = neighbours.MultiIndex(neighbours.Rotation(v, 1), np.arange(900), v)
    for radius in (0, 1, 2, 3, 30, 31, 90, 256):
        for code in index.codes[:20]:
            want = np.flatnonzero(np.bitwise_count(index.codes ^ code).sum(1, dtype=int) <= radius)
            assert index.within(code, radius).tolist() == want.tolist()
    share = np.mean([len(index.within(c, index.rotation.radius)) for c in index.codes]) / 900
    found = index.search(np.arange(900), v, 1)
    assert share < 0.1 and np.mean((found[0] - found[1]) % 450 == 0) >= 0.95


def test_learning_is_bounded(spark, monkeypatch):
    docs, labels = quality_tables(spark)
    docs = docs.unionByName(docs).unionByName(docs.withColumn("text", F.repeat("text", 5000)))
    monkeypatch.setattr(quality, "FIT_ROWS", 20)
    monkeypatch.setattr(quality, "FIT_BYTES", 4000)
    seen = []
    monkeypatch.setattr(quality.ByteConvNet, "fit", lambda self, texts, y: (seen.append((texts, y)), self)[1])
    quality.learn(docs, labels)
    assert 0 < len(seen[0][0]) <= 20 and sum(map(len, seen[0][0])) <= 4000 and len(seen[0][0]) == len(seen[0][1])


def test_pipeline(spark, tmp_path):
    docs, labels = quality_tables(spark)
    r = random.Random(8)
    item = words(r, 14).replace("é", "e")  # only A-Z are lower-cased
    passage = words(r, 120)
    extra = [(1000, words(r, 60), 0), (1001, None, 0), (1002, words(r, 20) + " " + item.upper() + " " + words(r, 9), 0), (1003, words(r, 50) + " " + passage, 0), (1004, words(r, 40) + " " + passage + " " + words(r, 3), 0)]
    extra[1] = (1001, extra[0][1], 0)
    docs = docs.unionByName(spark.createDataFrame([(a, b, "en", "s", len(b)) for a, b, _ in extra], docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = store.materialise(stage(spark, now, str(tmp_path)), "stage")
        seen[name] = now.collect()
        assert name == "packing" or now.columns == docs.columns
    ids = {k: [x.doc_id for x in v] for k, v in seen.items()}
    assert all(i in ids["quality classifier"] for i in (1000, 1001, 1002, 1003, 1004)) and sum(i is not None and i < 160 and i % 5 == 0 for i in ids["quality classifier"]) <= 3
    assert 1000 in ids["SimHash near-dedup"] and 1001 not in ids["SimHash near-dedup"]
    left = {x.doc_id: x for x in seen["suffix-array dedup"]}
    assert passage[10:-10] not in left[1003].text and left[1003].n_chars == len(left[1003].text) and left[1000].text == extra[0][1]
    clean = [x[0] for x in brute_hits([(x.doc_id, x.text) for x in seen["suffix-array dedup"]], [(1, item)]) if not x[2]]
    assert sorted(ids["benchmark decontamination"], key=str) == sorted(clean, key=str) and 1002 not in clean
    assert {x.doc_id for x in seen["packing"]} == {*clean}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_pipeline_of_odd_tables(spark, tmp_path):
    docs, labels = quality_tables(spark)
    # Columns named like those that the stages make, repeated rows, ids of several texts, long, null and empty texts.
    names = ["mark", "id", "row", "key", "words", "n", "start", "left_over", "cut_id", "score", "length", "_mark", "kept_id", "own_mark", "whole"]
    r = random.Random(21)
    extra = [(1, words(r, 40)), (1, words(r, 40)), (7000, None), (7001, ""), (7002, " ".join(words(r, 50) for _ in range(300))), (None, None)]
    docs = docs.unionByName(spark.createDataFrame([(a, b, "en", "s", len(b or "")) for a, b in extra], docs.schema))
    docs = docs.unionByName(docs.where("doc_id in (6, 7)")).withColumns({n: F.lit("own") for n in names})
    for name, table in (("docs", docs), ("none", docs.limit(0))):
        folder = f"{tmp_path}/{name}"
        table.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        now, before = spark.read.parquet(f"{folder}/documents.parquet"), None
        for stage, f in corpus_pipeline.STAGES:
            now = store.materialise(f(spark, now, folder), "stage")
            if stage != "packing":
                assert now.columns == docs.columns and all(x[n] == "own" for x in now.collect() for n in names)
                before = now.count()
        assert {x.doc_id for x in now.collect()} == ({x.doc_id for x in now.select("doc_id").collect()} if before else set())
        assert (before > 0) == (name == "docs") and (now.count() > 0) == (name == "docs")


def test_passages_of_51_short_words_go(spark):
    r = random.Random(14)
    passage, shorter = ([f"{r.choice('abcdefgh')}{i}" for i in range(at, at + n)] for at, n in ((10, 51), (70, 50)))
    docs = []
    for i, (part, space) in enumerate([(passage, " "), (passage, "\n"), (shorter, " "), (shorter, " ")]):
        text = f"own{i} " * 3 + space.join(part) + f" end{i} Ünd{i}"
        docs.append((i, text, len(text)))
    none = "x" * 300  # under 400 bytes and a word only
    docs += [(10, none + " p q", 304), (11, none + " y z", 304), (12, None, 0), (None, " ".join(passage), 9), (13, "p" + "x" * 420 + "q", 422), (14, "r" + "x" * 420 + "s", 422)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long").repartition(3)
    left = {x.doc_id: x for x in corpus_pipeline.suffix_dedup(spark, df, "").collect()}
    assert left[0].text.split() == ["own0"] * 3 + ["end0", "Ünd0"] and left[1].text.split() == ["own1"] * 3 + ["end1", "Ünd1"] and left[0].n_chars == len(left[0].text)
    assert all(left[i].text == docs[i][1] for i in (2, 3)) and left[10].text == docs[4][1] and left[11].text == docs[5][1] and left[12].text is None and None not in left
    assert left[13].text == "pq" and left[14].text == "rs"
