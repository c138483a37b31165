"""Nested fields, sketches, needed sources, patterns inside names: small cases and brute force."""

import json
import random
import re
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.operators import nested, resolve, sections, sketches
from sightline.sources import needed

T0 = datetime(2024, 1, 1)


def wanted(patterns, names):
    hit = lambda p, n: re.fullmatch(".*".join(map(re.escape, p.split("*"))), n, re.S)
    return {(p, n) for p in patterns for n in names if p is not None and n is not None and hit(p, n)}


def found(spark, patterns, names):
    rows = resolve.matches(spark.createDataFrame([(p,) for p in patterns], "pattern string"), spark.createDataFrame([(n,) for n in names], "source string")).collect()
    got = {(r.pattern, r.source) for r in rows}
    assert len(got) == len(rows)
    return got


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab.\\E*%é\U0001f600", max_size=7), max_size=30), st.lists(st.text("ab.\\E%é\U0001f600\n", max_size=8), max_size=30))
def test_matches_as_a_nested_loop(spark, patterns, names):
    patterns, names = [*patterns, "*", "**", "", None], [*names, "", None]
    assert found(spark, patterns, names) == wanted(patterns, names)


def test_matches_of_long_texts_and_empty_tables(spark):
    names, patterns = ["x" * 100 + "a", "x" * 70, "y" + "x" * 99], ["x" * 90 + "*", "*" + "x" * 80 + "a", "*" + "x" * 99 + "*", "x" * 70]
    assert found(spark, patterns, names) == wanted(patterns, names)
    assert found(spark, [], names) == set() and found(spark, patterns, []) == set()


def test_no_key_holds_all_names(spark):
    names = [f"logs-{a}-{i:04}" for i in range(500) for a in ("click", "view")]
    n = spark.createDataFrame([(x,) for x in names], "source string")
    p = spark.createDataFrame([("*-0123*",), ("*click-00*",), ("*",)], "pattern string")
    asked, keys = resolve._asked(resolve._wanted(p), n)
    pairs = asked.join(keys, ["kind", "part", "salt"]).groupBy("kind", "part", "salt").count().collect()
    # The rarest piece of a pattern is all that is looked up; every name goes to one of many keys for "*".
    assert max(r["count"] for r in pairs if r.kind == "all") < 100
    assert {r.part: r["count"] for r in pairs if r.kind == "gram"}["123"] == 2 and max(r["count"] for r in pairs if r.kind == "gram") <= 500
    assert {r.kind for r in keys.select("kind").distinct().collect()} == {"gram", "all"}


def flat(value, path=""):
    """All (path, type) of a value, the plain way."""
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "long", float: "double", type(None): "null"}[type(value)]
    out = {(path, kind)} if path else set()
    inner = value.items() if isinstance(value, dict) else [(None, x) for x in value] if isinstance(value, list) else []
    for k, v in inner:
        out |= flat(v, f"{path}[]" if k is None else f"{path}.{k}" if path else k)
    return out


def snapshot(spark, texts):
    rows = nested.nested_snapshot(spark.createDataFrame([("s", t) for t in texts], "source string, props string")).collect()
    return {(r.field, t) for r in rows for t in r.types}


def test_nested_snapshot_as_a_plain_walk(spark):
    rnd = random.Random(3)

    def value(depth):
        kind = rnd.randint(0, 7 if depth else 5)
        if kind < 6:
            return [rnd.randint(-9, 9), rnd.random() + 0.5, "t{[\"\\", True, None, 10**25][kind - 1]
        return [value(depth - 1) for _ in range(rnd.randint(0, 3))] if kind == 6 else {rnd.choice("abcd"): value(depth - 1) for _ in range(rnd.randint(0, 3))}

    docs = [{rnd.choice("abcdef"): value(4) for _ in range(4)} for _ in range(60)]
    assert snapshot(spark, [json.dumps(d) for d in docs]) == set().union(*map(flat, docs))


def test_nested_snapshot_of_odd_texts(spark):
    assert snapshot(spark, [None, "", "{bad", "[1]", "5", "{}", '{"k":1,"k":2}']) == set()
    assert snapshot(spark, []) == set()
    deep = '{"a":' * 60 + "1" + "}" * 60
    long = json.dumps({"t": "x\\\"{" * 100_000, "w<`": {"o.p": 1.0}})
    assert snapshot(spark, [deep, long]) == {(".".join("a" * i), "object" if i < 60 else "long") for i in range(1, 61)} | {("t", "string"), ("w<`", "object"), ("w<`.o.p", "double")}


def test_one_example_of_a_shape(spark):
    texts = [f'{{"n":{{"i":{i}}}}}' for i in range(200)] + ['{"n":{"i":"x"}}']
    df = spark.createDataFrame([("s", t) for t in texts], "source string, props string")
    assert nested.shape_examples(df).count() == 2
    assert nested.shape_examples(df.withColumn("shape", F.lit(1)).withColumn("json", F.lit("clash"))).count() == 2


def sketch_events(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), (F.lit(T0) + F.make_dt_interval(hours=(F.col("id") % 48).cast("int"))).alias("event_ts"), F.col("id").alias("v")).withColumn(
        "ingest_ts", F.col("event_ts") + F.expr("make_dt_interval(0, 0, 0, pmod(xxhash64(v), 100000) / 1000)"))


def test_sketches_are_within_their_error_and_merge_in_any_order(spark):
    ev = sketch_events(spark, 60_000)
    hours = sketches.hourly_sketches(ev, "v")
    for kept, span in ((ev, hours), (ev.where(F.col("event_ts") >= F.lit(T0 + timedelta(days=1))), sketches.within_span(hours, T0 + timedelta(days=1)))):
        counts = sketches.lag_counts(kept, "source")
        want = {r.source: r for r in sketches.exact_quantile(counts, "source").join(sketches.exact_distinct(kept, "v", "source"), "source").collect()}
        parts = sketches.merged_sketches(span, "source", F.hour("hour").alias("h"))
        for merged in (sketches.merged_sketches(span, "source"), sketches.merged_sketches(parts, "source")):
            got = sketches.estimates(merged)
            for r in got.collect():
                assert r.n_lags == r.docs == want[r.source].n_lags and abs(r.n_values / want[r.source].n_values - 1) < 5 * sketches.DISTINCT_ERROR
            assert all(r.rank_error <= 3 * sketches.RANK_ERROR for r in sketches.rank_errors(counts, got, "source").collect())


def test_sketches_of_nothing(spark):
    row = "source string, event_ts timestamp, ingest_ts timestamp, v long"
    none = spark.createDataFrame([("a", None, T0, None), ("a", T0, None, 3), (None, T0, T0 - timedelta(1), 3)], row)
    got = {r.source: r for r in sketches.estimates(sketches.merged_sketches(sketches.hourly_sketches(none, "v"), "source")).collect()}
    assert (got["a"].docs, got["a"].n_lags, got["a"].lag_ms, got["a"].n_values) == (2, 0, None, 1)
    assert (got[None].n_lags, got[None].lag_ms, got[None].n_values) == (1, 0, 1)
    assert sketches.estimates(sketches.merged_sketches(sketches.hourly_sketches(none.where("false"), "v"), "source")).count() == 0


def scanned(df):
    """Rows that the scans of files gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text, rows = plan.toString(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            rows += node.metrics().get("numOutputRows").get().value()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return rows, text


def test_only_needed_events_leave_the_scan(spark, tmp_path):
    path = f"{tmp_path}/events"
    spark.range(9000).select((F.concat(F.lit("s"), (F.col("id") % 9).cast("string"))).alias("source"), "id").repartition("source").write.partitionBy("source").parquet(path)
    ev = spark.read.parquet(path)
    names = spark.createDataFrame([("s1",), ("s7",), ("s7",), ("gone",), (None,)], "source string")
    assert scanned(ev.groupBy().agg(F.sum("id")))[0] == 9000
    few, many = needed.needed_events(ev, names), needed.needed_events(ev, names, listed=1)
    assert few.columns == many.columns == ev.columns
    assert scanned(few.groupBy().agg(F.sum("id")))[0] == 2000
    assert sorted(few.collect()) == sorted(many.collect()) == sorted(ev.where("source in ('s1', 's7')").collect())
    assert "LeftSemi" in scanned(many)[1]
    assert needed.needed_events(ev, names.where("false")).count() == 0


def test_needed_events_by_a_column_of_another_name(spark):
    ev = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "stream string, source long")
    names = spark.createDataFrame([("b",)], "source string")
    for listed in (10, 0):
        assert [tuple(r) for r in needed.needed_events(ev, names, "stream", listed).collect()] == [("b", 2)]


def test_sections_in_order(spark):
    rows = [(f"r{i % 40}", ["resolved", "empty"][i % 2], f"e{i % 7}", f"s{i}", i % 3 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "rule_id string, status string, expression string, selector string, diagnostic boolean")
    want = sorted(rows, key=lambda r: (r[0], r[1], r[2] + r[3], r[4]))
    got = sorted(sections.placed(df.repartition(7), "resolutions").collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(1, 401)) and [tuple(r)[:5] for r in got] == want
    assert [tuple(r) for r in sections.in_order(df, "resolutions").collect()] == want
    assert sections.placed(df.where("false"), "resolutions").count() == 0
    same = sections.placed(spark.createDataFrame([("r", "s", None, None, None)] * 9, df.schema), "resolutions")
    assert sorted(r.place for r in same.collect()) == list(range(1, 10))
