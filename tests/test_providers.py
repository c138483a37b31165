"""Scans of providers that know all, some or nothing; rule files as a data source."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sightline.sources.provider import EventsProvider, Provider, ProviderScan, told
from sightline.sources.rulefiles import RuleFiles, scan_rule_files
from sightline.sources.tables import normalise_rules

NOW = datetime(2024, 1, 31, 12)
RULE = "rule_id string, name string, enabled boolean, severity string, patterns array<string>, interval_s long, lookback_s long, timestamp_override string, required_fields array<string>"
EVENT = "source string, event_ts timestamp, ingest_ts timestamp, size_bytes long, props string"


def ago(**k):
    return NOW - timedelta(**k)


def rules(spark):
    rule = lambda i, pattern, fields=(), on=True: (i, i, on, "high", [pattern], 300, 600, "", list(fields))
    return spark.createDataFrame([rule("fresh", "logs-a", ["user.id"]), rule("late", "logs-late", ["user.id"]), rule("lacks", "logs-a", ["user.name"]), rule("old", "logs-old"), rule("none", "gone-*"), rule("off", "logs-off", on=False)], RULE)


def events(spark):
    rows = [("logs-a", ago(minutes=5), ago(minutes=5), 1, '{"user":{"id":1}}'), ("logs-late", ago(minutes=50), ago(minutes=10), 1, '{"user":{"id":1}}'), ("logs-old", ago(days=3), ago(days=3), 1, None), ("logs-off", ago(minutes=5), ago(minutes=5), 1, None)]
    return spark.createDataFrame(rows, EVENT)


def sections(scan):
    return {r.rule_id: (r.section, r.reason) for r in scan.verdicts.collect()}


class Blind(Provider):
    """Knows rules and an inventory without last events, nothing else."""

    def __init__(self, spark):
        self.spark = spark

    def rules(self):
        return rules(self.spark)

    def sources(self):
        return events(self.spark).groupBy("source").agg(F.count("*").alias("docs"), F.sum("size_bytes").alias("size_bytes"), F.lit(None).cast("timestamp").alias("last_event"))


class Partly(Blind):
    """Empty windows for one source, two answers for another, none for the rest."""

    def freshness(self, requests):
        return self.spark.createDataFrame([("logs-old", "assessed", None), ("logs-a", "assessed", ago(days=9)), ("logs-a", "assessed", NOW), ("logs-off", "assessed", None)], "source string, status string, last_event timestamp")


def test_scan_of_events(spark):
    scan = ProviderScan(EventsProvider(events(spark), rules(spark), NOW, "props"), NOW, 3600)
    assert sections(scan) == {"fresh": ("live", ""), "late": ("impaired", "lag-blind-window"), "lacks": ("impaired", "missing-fields"), "old": ("dead", "starved"), "none": ("dead", "disconnected")}
    assert {r.source for r in scan.needed.collect()} == {"logs-a", "logs-late", "logs-old"}
    assert {r.source: r.status for r in scan.fields.collect()} == {"logs-a": "assessed", "logs-late": "assessed", "logs-old": "incomplete"}


def test_unavailable_evidence_makes_no_verdict(spark):
    scan = ProviderScan(Blind(spark), NOW, 3600)
    assert {r.status for df in (scan.freshness, scan.lag, scan.fields) for r in df.collect()} == {"unavailable"}
    assert scan.lag.columns == ["source", "status", "sample_count", "p95_s", "max_s"] and scan.lag.count() == 3
    assert sections(scan) == {"fresh": ("live", ""), "late": ("live", ""), "lacks": ("live", ""), "old": ("live", ""), "none": ("dead", "disconnected")}


def test_two_answers_are_none_and_an_empty_window_bounds_the_age(spark):
    scan = ProviderScan(Partly(spark), NOW, 3600)
    assert {r.source: r.status for r in scan.freshness.collect()} == {"logs-a": "unavailable", "logs-late": "unavailable", "logs-old": "assessed"}
    assert {r.source: (r.status, r.lower_bound) for r in scan.health.collect()}["logs-old"] == ("stale", True)
    assert sections(scan)["old"] == ("dead", "starved") and sections(scan)["fresh"] == ("live", "")


def test_without_rules_or_events(spark):
    for e, r in ((events(spark).where("false"), rules(spark)), (events(spark), rules(spark).where("false"))):
        got = sections(ProviderScan(EventsProvider(e, r, NOW, "props"), NOW, 3600))
        assert set(got.values()) <= {("dead", "disconnected")}
    with pytest.raises(NotImplementedError):
        _ = ProviderScan(Provider(), NOW, 1).rules


def test_told_keeps_its_columns(spark):
    asked = spark.createDataFrame([("a",), ("a",), (None,)], "source string")
    found = spark.createDataFrame([("a", None, 1), ("b", "assessed", 2)], "source string, status string, n long")
    assert [tuple(r) for r in told(found, asked, "n long").collect()] == [("a", "unavailable", 1)]
    assert [tuple(r) for r in told(None, asked, "n long").collect()] == [("a", "unavailable", None)]


@pytest.fixture()
def folder(tmp_path):
    one = {"rule_id": "a", "name": "A", "enabled": True, "index": ["logs-*", None], "risk_score": 7, "type": "query", "interval": "5m", "from": "now-10m", "extra": {"x": 1}}
    (tmp_path / "deep").mkdir()
    (tmp_path / "one.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "deep" / "many.json").write_text(json.dumps([{**one, "rule_id": "b"}, {"rule_id": 5, "enabled": "yes", "index": "logs"}]))
    (tmp_path / "lines.ndjson").write_text("﻿" + "\n\n".join(json.dumps({**one, "rule_id": x, "type": "eql"}) for x in "cd"))
    (tmp_path / "broken.json").write_text('{"rule_id": ')
    (tmp_path / "list.json").write_text("[1]")
    (tmp_path / "empty.jsonl").write_text("[]")
    (tmp_path / "notes.txt").write_text("no rule")
    return str(tmp_path)


def test_rule_files(spark, folder):
    spark.dataSource.register(RuleFiles)
    df = spark.read.format("rule_files").load(folder)
    got = {(r.file, r.rule_id): r for r in df.collect()}
    assert set(got) == {("one.json", "a"), ("deep/many.json", "b"), ("deep/many.json", "5"), ("lines.ndjson", "c"), ("lines.ndjson", "d"), ("broken.json", None), ("list.json", None)}
    assert {f for (f, _), r in got.items() if r.problem} == {"broken.json", "list.json"}
    assert got["one.json", "a"]["index"] == ["logs-*"] and got["one.json", "a"].risk_score == 7.0
    assert (got["deep/many.json", "5"].enabled, got["deep/many.json", "5"]["index"]) == (None, None)
    assert sorted(map(str, scan_rule_files(spark, folder).collect())) == sorted(map(str, got.values()))
    ready = {r.rule_id: (r.enabled, r.patterns, r.interval_s, r.lookback_s) for r in normalise_rules(df.where("problem is null"), "index").collect()}
    assert ready["c"] == (True, ["logs-*"], 300, 600) and ready["5"] == (False, [], 0, 0)


def test_filters_reach_the_files(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = lambda: scan_rule_files(spark, folder)
        assert read().rdd.getNumPartitions() == 6
        few = read().where("file in ('one.json', 'lines.ndjson')")
        assert few.rdd.getNumPartitions() == 2 and {r.rule_id for r in few.collect()} == {"a", "c", "d"}
        assert [r.rule_id for r in read().where("type = 'eql' and rule_id > 'c'").collect()] == ["d"]
        assert {r.file for r in read().where("problem is not null").collect()} == {"broken.json", "list.json"}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
