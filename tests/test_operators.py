"""Verdicts, health, history and findings on small cases."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sightline.operators import evidence, findings, history, resolve, verdicts

NOW = datetime(2024, 1, 31, 12)
SRC = "source string, docs bigint, size_bytes bigint, last_event timestamp"
RULE = "rule_id string, name string, enabled boolean, severity string, patterns array<string>"


def ago(**k):
    return NOW - timedelta(**k)


def sources(spark):
    return spark.createDataFrame([
        ("logs-live-default", 100, 10, ago(minutes=1)), ("logs-stale-default", 100, 20, ago(hours=2)), ("logs-unused-default", 100, 999, ago(minutes=1)),
        ("logs-shelfware-default", 100, 500, ago(minutes=1)), ("mystery-default", 100, 5, None)], SRC)


def rules(spark):
    return spark.createDataFrame([
        ("r-live", "live", True, "high", ["logs-live-*"]), ("r-starved", "starved", True, "critical", ["logs-stale-*"]), ("r-disconnected", "disc", True, "medium", ["netflow-*"]), ("r-unmapped", "unm", True, "low", []),
        ("r-disabled", "dis", False, "high", ["logs-live-*", "logs-shelfware-*"]), ("r-uncertain", "unc", True, "high", ["mystery-*"])], RULE)


def test_classification(spark):
    s, r = sources(spark), rules(spark)
    h = verdicts.source_health(s, NOW, 1800.0)
    e = resolve.pattern_edges(r, s)
    v = {x.rule_id: (x.section, x.reason) for x in verdicts.rule_verdicts(r, e, h).collect()}
    assert v == {"r-live": ("live", ""), "r-starved": ("dead", "starved"), "r-disconnected": ("dead", "disconnected"), "r-unmapped": ("unmapped", "unsupported"), "r-uncertain": ("live", "")}
    unused = verdicts.unused_telemetry(s, e, r)
    assert [tuple(x) for x in unused.collect()] == [("logs-unused-default", 999, 0), ("logs-shelfware-default", 500, 1)]
    counts = {x.counter: x.n for x in verdicts.summary_rollup(h, verdicts.rule_verdicts(r, e, h), r, unused).collect()}
    assert (counts["rules"], counts["enabled_rules"], counts["healthy_sources"], counts["degraded_sources"], counts["dead_detections"], counts["unmapped_rules"], counts["unused_bytes"]) == (6, 5, 3, 1, 2, 1, 1499)


@pytest.mark.parametrize("docs, last, bounded, stale_s, status", [
    (1, ago(minutes=5), None, 1800, "ok"), (1, ago(minutes=30), None, 1800, "ok"), (1, ago(minutes=31), None, 1800, "stale"), (0, ago(minutes=1), None, 1800, "empty"),
    (10, None, None, 1800, "unknown"), (None, None, None, 1800, "unknown"), (10, None, 86400.0, 86400, "stale"), (10, None, 86400.0, 90000, "unknown")])
def test_health(spark, docs, last, bounded, stale_s, status):
    s = spark.createDataFrame([("a", docs, 0, last)], SRC)
    b = spark.createDataFrame([("a", bounded)], "source string, window_s double")
    assert verdicts.source_health(s, NOW, float(stale_s), bounded=b).first().status == status


@pytest.mark.parametrize("start, end, days, tz, hit", [
    (660, 780, [], "UTC", True), (720, 721, [], "UTC", True), (660, 720, [], "UTC", False), (1380, 750, [], "UTC", True), (1380, 750, [2], "UTC", True), (1380, 750, [3], "UTC", False),
    (660, 780, [3], "UTC", True), (660, 780, [4], "UTC", False), (780, 840, [], "Europe/Berlin", True), (780, 1439, [], "UTC", False)])
def test_downtime(spark, start, end, days, tz, hit):
    """NOW is a Wednesday at noon."""
    w = spark.createDataFrame([(["a*"], days, start, end, tz)], "patterns array<string>, days array<int>, start_min int, end_min int, tz string")
    s = spark.createDataFrame([("ab",), ("c",)], "source string")
    assert dict(map(tuple, verdicts.downtime_match(s, w, NOW).collect())) == {"ab": hit, "c": False}


def test_resolution_with_exclusions_and_remote(spark):
    r = spark.createDataFrame([("a", ["logs-*", "-logs-stale-*"]), ("b", ["x:logs-*", "nothing"]), ("c", []), ("d", ["logs-{a:b}*"])], "rule_id string, patterns array<string>")
    got = {(x.rule_id, x.status): x.resolved_sources for x in resolve.resolve_selectors(r, sources(spark)).collect()}
    assert got == {("a", "resolved"): ["logs-live-default", "logs-shelfware-default", "logs-unused-default"], ("b", "remote"): [], ("b", "empty"): [], ("c", "unsupported"): [], ("d", "empty"): []}


RES = "rule_id string, ordinal int, diagnostic boolean, selector string, expression string, status string, detail string, resolved_sources array<string>"


@pytest.mark.parametrize("rows, want", [
    ([], {("unmapped", "unsupported")}),
    ([(False, "resolved", ["s1"])], {("live", "")}),
    ([(False, "resolved", ["s1", "gone"])], {("unmapped", "ambiguous")}),
    ([(False, "empty", [])], {("dead", "disconnected")}),
    ([(False, "incompatible", [])], {("dead", "source-plan-incompatible")}),
    ([(False, "remote", []), (False, "empty", [])], {("remote", "remote")}),
    ([(False, "remote", []), (False, "unavailable", [])], {("remote", "remote"), ("unmapped", "unavailable")}),
    ([(False, "unavailable", [])], {("unmapped", "unavailable")}),
    ([(False, "resolved", ["s2"])], {("dead", "starved")}),
    ([(False, "resolved", ["s1", "s2"])], {("live", "")}),
    ([(False, "resolved", ["s2"]), (True, "unsupported", [])], {("unmapped", "unsupported")}),
    ([(False, "resolved", ["s1"]), (True, "incompatible", [])], {("impaired", "source-plan-incompatible")}),
])
def test_verdict_order(spark, rows, want):
    s = spark.createDataFrame([("s1", 1, 1, NOW), ("s2", 1, 1, ago(days=1))], SRC)
    r = spark.createDataFrame([("r", "n", True, "low", ["x"]), ("other", "o", True, "low", ["x"])], RULE)
    data = [("r", i, d, "sel", "sel", st, "", t) for i, (d, st, t) in enumerate(rows)] + [("other", 0, False, "", "", "empty", "", [])]
    res = spark.createDataFrame(data, RES)
    e = resolve.resolved_edges(res.where("not diagnostic"), r, s)
    v = verdicts.rule_verdicts(r, e, verdicts.source_health(s, NOW, 3600.0), verdicts.rule_flags(res, s))
    assert {(x.section, x.reason) for x in v.where("rule_id = 'r'").collect()} == want


def test_impairment_names_only_late_sources(spark):
    r = spark.createDataFrame([("r", 600, 300, "", ["f", "g"]), ("i", 600, 300, "event.ingested", [])], "rule_id string, lookback_s long, interval_s long, timestamp_override string, required_fields array<string>")
    e = spark.createDataFrame([("r", "a"), ("r", "b"), ("i", "a")], "rule_id string, source string")
    lag = spark.createDataFrame([("a", "assessed", 5, 1800.0, 2000.0), ("b", "assessed", 5, 300.0, 400.0)], "source string, status string, sample_count long, p95_s double, max_s double")
    fe = spark.createDataFrame([("a", "assessed", ["f"]), ("b", "assessed", ["f", "g"])], "source string, status string, fields array<string>")
    [x] = verdicts.rule_impairment(e, r, lag, verdicts.required_fields(e, r, fe)).collect()
    assert (x.reasons, x.missing_fields, x.lag_sources, x.p95_s) == (["missing-fields", "lag-blind-window"], ["g"], ["a"], 1800.0)
    incomplete = fe.withColumn("status", F.when(F.col("source") == "b", "incomplete").otherwise("assessed"))
    [x] = verdicts.rule_impairment(e, r, lag, verdicts.required_fields(e, r, incomplete)).collect()
    assert x.reasons == ["lag-blind-window"]


def fold(scans, **k):
    return [x[1] for x in history.fold_volume({}, scans, **k)]


def test_volume_fold():
    hour, docs, rows = 3600, 0, []
    for i, n in enumerate([0, 100, 101, 99, 100, 5, 5, 100]):
        docs += n
        rows.append((i * hour, "b", docs, False))
    assert fold(rows, warmup_s=0) == ["unknown", "warming", "warming", "warming", "warming", "pending", "low", "ok"]
    assert fold(rows, warmup_s=86400) == ["unknown"] + ["warming"] * 7
    flat = [(i * hour, "b", d, False) for i, d in enumerate([0, 100, 200, 300, 400, 460, 500])]
    assert fold(flat, warmup_s=0, hysteresis=1) == ["unknown", "warming", "warming", "warming", "warming", "ok", "low"]  # the 60 widens the bucket, 40 is low by z then
    assert fold([(0, "b", 10, False), (hour, "b", 5, False), (2 * hour, "b", None, False), (3 * hour, "b", 9, False), (4 * hour, "b", 12, True)]) == ["unknown"] * 4 + ["maintenance"]


def test_schema_drift(spark):
    day = lambda i: NOW + timedelta(days=i)
    m = lambda **k: {a: [b] for a, b in k.items()}
    rows = [("s", day(0), True, m(a="long")), ("s", day(1), True, m(a="long", b="x")), ("s", day(2), False, None), ("s", day(3), True, m(a="text", b="x")), ("s", day(4), True, m(a="text")), ("s", day(5), True, m(a="text"))]
    out = history.schema_drift(spark.createDataFrame(rows, "source string, scan_ts timestamp, fetched boolean, fields map<string,array<string>>")).orderBy("scan_ts").collect()
    assert [x.status for x in out] == ["warming", "drift", "unknown", "drift", "drift", "ok"]
    assert (out[1].added, out[3].type_changed, out[4].removed) == (["b"], ["a"], ["b"])


FIND = "finding_id string, class string, severity string, gates boolean"


def test_policy_and_diff(spark):
    f = spark.createDataFrame([("1", "dead-detection", "low", None), ("2", "dead-detection", "high", None), ("3", "source-degraded", "", None), ("4", "dead-detection", "", None), ("5", "dead-detection", "critical", None)], FIND).drop("gates")
    acc = spark.createDataFrame([("5", NOW + timedelta(days=1)), ("2", ago(days=1))], "finding_id string, expires_at timestamp")
    g = {x.finding_id: (x.gates, x.acceptance) for x in findings.apply_policy(f, ["dead-detection", "source-degraded"], acc, NOW, "high").collect()}
    assert g == {"1": (False, None), "2": (True, "expired"), "3": (True, None), "4": (True, None), "5": (False, "active")}
    old = spark.createDataFrame([("1", "dead-detection", "", True), ("2", "unused-telemetry", "", False)], FIND)
    assert findings.scan_diff(old, old).count() == 0
    none = spark.createDataFrame([], "finding_id string")
    assert findings.scan_diff(old, old.limit(0), none).count() == 0  # lost evidence is no recovery
    assert {x.change for x in findings.scan_diff(old.limit(0), old).collect()} == {"new"}
    assert {(x.finding_id, x.regression) for x in findings.scan_diff(old.limit(0), old).collect()} == {("1", True), ("2", False)}


def test_fleet(spark):
    v = spark.createDataFrame([("a", "R", "low", "dead"), ("b", "R", "high", "dead"), ("b", "S", "critical", "impaired"), ("c", "R", "low", "dead")], "instance string, name string, severity string, section string")
    i = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "instance string, ok boolean")
    assert [tuple(x) for x in findings.fleet_rollup(v, i).collect()] == [("R", "low", 2, 0, 2), ("S", "critical", 0, 1, 2)]
    assert findings.fleet_rollup(v.limit(0), i).count() == 0


def test_metrics(spark):
    df = spark.createDataFrame
    scans = df([("a", True, NOW, "legacy"), ("b", True, ago(hours=1), "unavailable"), ("c", False, ago(hours=2), None)], "instance string, ok boolean, scan_ts timestamp, unused_status string")
    health = df([
        ("a", "s", "stale", 90.0, False, 2, "low", -4.5, "drift"), ("a", "t", "maintenance", 5.0, False, None, "warming", None, "ok"), ("a", "u", "ok", 1.0, True, 0, None, None, None), ("a", "v", "unknown", None, False, 0, None, None, None),
        ("c", "s", "ok", 1.0, False, 1, "ok", 0.1, "ok")], "instance string, source string, status string, age_s double, lower_bound boolean, consumers int, volume_status string, volume_z double, schema_status string")
    verdict = df([("a", "dead"), ("a", "dead"), ("b", "impaired"), ("c", "dead")], "instance string, section string")
    unused, res = df([("a", 7), ("a", 3)], "instance string, size_bytes int"), df([("a", "resolved", 4), ("b", "incompatible", 2)], "instance string, status string, n int")
    rows = [(x.metric, json.loads(x.labels), x.value) for x in findings.metrics_long(scans, health, verdict, unused, res).collect()]
    got = {(m, *lab.values()): v for m, lab, v in rows}
    assert len(got) == len(rows) and got["up",] == 0 and got["last_scan_timestamp_seconds",] == NOW.replace(tzinfo=timezone.utc).timestamp()
    each = lambda m: {k[1:]: v for k, v in got.items() if k[0] == m}
    assert each("instance_up") == {("a",): 1, ("b",): 1, ("c",): 0}
    assert each("dead_rules") == {("a",): 2, ("b",): 0} and each("impaired_rules") == {("a",): 0, ("b",): 1} and each("unmapped_rules") == {("a",): 0, ("b",): 0}
    assert each("unused_bytes") == {("a",): 10, ("b",): 0} and each("unused_assessed") == {("a",): 1, ("b",): 0}
    assert {k: v for k, v in each("sources").items() if v} == {("a", x): 1 for x in ("stale", "maintenance", "ok", "unknown")} and len(each("sources")) == 10
    assert {k: v for k, v in each("input_resolutions").items() if v} == {("a", "resolved"): 4, ("b", "incompatible"): 2} and len(each("input_resolutions")) == 14
    assert each("freshness_seconds") == {("a", "s"): 90, ("a", "t"): 5} and each("consumers") == {("a", "s"): 2, ("a", "t"): 0, ("a", "u"): 0, ("a", "v"): 0}
    assert each("volume_zscore") == {("a", "s"): -4.5} and each("volume_low") == {("a", "s"): 1, ("a", "t"): 0} and each("schema_drift") == {("a", "s"): 1, ("a", "t"): 0}
    none = findings.metrics_long(scans.limit(0), health, verdict, unused, res).collect()
    assert [(x.metric, x.value) for x in none] == [("up", 0.0)]


def test_lag_is_nearest_rank_and_clamped(spark):
    rows = [("s", i, NOW - timedelta(seconds=60 + i), NOW - timedelta(seconds=60)) for i in range(1, 41)] + [("s", 99, NOW, NOW - timedelta(seconds=5))]
    ev = spark.createDataFrame(rows, "source string, event_id long, event_ts timestamp, ingest_ts timestamp")
    s = spark.createDataFrame([("s", 41), ("t", 0), ("u", 3)], "source string, docs long")
    got = {x.source: (x.status, x.sample_count, x.p95_s, x.max_s) for x in evidence.ingest_lag(ev, s, NOW).collect()}
    assert got == {"s": ("assessed", 41, 38.0, 40.0), "t": ("disabled", 0, None, None), "u": ("incomplete", 0, None, None)}


def test_prefix_join_is_no_nested_loop(spark):
    plan = resolve.pattern_edges(rules(spark), sources(spark).repartition(4))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_exact_lag_is_counted_by_lag(spark):
    """The nearest rank of all lags, without an aggregate that holds every lag of a source."""
    import math
    import random

    r = random.Random(4)
    lags = {s: [r.choice([0, 5, 5, 900, r.randint(0, 5000)]) for _ in range(n)] for s, n in (("a", 1), ("b", 20), ("c", 333))}
    ev = spark.createDataFrame([(s, i, NOW - timedelta(hours=1), NOW - timedelta(hours=1) + timedelta(milliseconds=x)) for s, xs in lags.items() for i, x in enumerate(xs)], "source string, event_id long, event_ts timestamp, ingest_ts timestamp")
    src = spark.createDataFrame([(s, len(x)) for s, x in lags.items()] + [("none", 0), ("quiet", 3)], "source string, docs long")
    out = evidence.ingest_lag(ev, src, NOW, exact=True)
    assert "percentile" not in out._jdf.queryExecution().executedPlan().toString()
    got = {x.source: (x.status, x.sample_count, x.p95_s, x.max_s) for x in out.collect()}
    want = {s: ("assessed", len(x), sorted(x)[math.ceil(0.95 * len(x)) - 1] / 1000, max(x) / 1000) for s, x in lags.items()}
    assert got == want | {"none": ("disabled", 0, None, None), "quiet": ("incomplete", 0, None, None)}


def test_fields_asked_of_their_sources_alone(spark):
    held = spark.createDataFrame([("a", 1, "x", True), ("a", 2, "x", True), ("a", 1, "y", True), ("b", 1, "x", False)], "source string, partition int, field string, ok boolean")
    asked = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("gone", "x"), ("a", "x")], "source string, field string")
    out = evidence.field_availability(held, asked)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [("a", "x", True), ("a", "y", False), ("b", "x", False)]
