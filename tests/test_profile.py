"""The one-pass profile against the operators that scan the events for one kind of evidence each."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sightline.operators import evidence, profile
from sightline.sources.shared import written

NOW = datetime(2024, 3, 5, 10, 30)
EVENT = "source string, tenant string, event_id long, event_ts timestamp, ingest_ts timestamp, size_bytes long, props string"


def events(spark, seed=1, n=1500):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        at = NOW - timedelta(seconds=r.choice([r.randint(-3600, 86400), r.randint(0, 900_000)]))
        late = timedelta(milliseconds=r.choice([0, 500, 500, 1500, -900, r.randint(0, 4_000_000)]))
        rows.append((r.choice(["a", "a", "a", "b", "c", ".sys"]), r.choice("xy"), i, r.choice([at] * 9 + [None]), r.choice([at + late] * 9 + [None]), i % 7, r.choice(["p", "q", None])))
    rows += [("old", "x", n, NOW - timedelta(days=9), NOW - timedelta(days=9), 1, None), ("never", "y", n + 1, None, None, 2, "p")]
    return spark.createDataFrame(rows, EVENT)


def fields(n=70):
    """More fields than one long has bits."""
    return [("p", "text", F.col("props") == "p"), ("q", "text", F.col("props") == "q"), ("size", "long", F.col("size_bytes") > 3), *[(f"n{i}", "long", F.col("event_id") % n == i) for i in range(n)]]


def same(a, b):
    key = sorted(a.columns)
    assert key == sorted(b.columns)
    rows = lambda df: sorted(map(str, df.select(*key).collect()))
    assert rows(a) == rows(b) != []


def test_profile_gives_what_single_scans_give(spark):
    ev = events(spark)
    p = written(profile.source_profile(ev, NOW, fields(), ("tenant", "source")), "profile")
    s = evidence.source_inventory(ev)
    same(profile.inventory(p), s)
    same(profile.inventory(p, "tenant", "source"), ev.where("source <> '.sys'").groupBy("tenant", "source").agg(F.count("*").alias("docs"), F.sum("size_bytes").alias("size_bytes"), F.max("event_ts").alias("last_event")))
    asked = s.select("source", F.explode(F.array(F.lit("event_time"), F.lit("ingestion_time"), F.lit("mixed"))).alias("basis"), F.lit(100_000).alias("max_stale_s"))
    same(profile.bounded_freshness(p, asked), evidence.bounded_freshness(ev, asked, NOW))
    same(profile.ingest_lag(p, s), evidence.ingest_lag(ev, s, NOW, exact=True))
    same(profile.hourly_volume(p), ev.where("event_ts is not null").groupBy("source", F.date_trunc("hour", "event_ts").alias("hour")).agg(F.count("*").alias("n")))
    held = F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("field"), F.lit(t).alias("type"))) for n, t, c in fields()]))).alias("f")
    day = F.to_date("event_ts").alias("by")
    same(profile.fields_seen(p, fields(), F.to_date("hour")), ev.select("source", day, held).select("source", "by", "f.*").distinct())


def test_profiles_of_parts_add_up(spark):
    ev = events(spark, 2)
    whole = profile.source_profile(ev, NOW, fields())
    parts = [profile.source_profile(ev.where(F.col("event_id") % 3 == i), NOW, fields()) for i in range(3)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    s = evidence.source_inventory(ev)
    same(profile.inventory(both), s)
    same(profile.ingest_lag(both, s), profile.ingest_lag(whole, s))
    same(profile.hourly_volume(both), profile.hourly_volume(whole))
    same(profile.fields_seen(both, fields(), F.lit(0)), profile.fields_seen(whole, fields(), F.lit(0)))
    same(profile.counters(both), profile.counters(whole))


def test_profile_of_nothing(spark):
    p = profile.source_profile(events(spark).limit(0), NOW, fields())
    assert p.count() == profile.inventory(p).count() == profile.counters(p).count() == profile.fields_seen(p, fields(), F.lit(0)).count() == 0


def test_one_scan_feeds_all_evidence(spark, monkeypatch):
    """The profile reads the events once, in one exchange of combined rows, and nothing after it reads them again."""
    from sightline.plans import fixtures as fx
    from sightline.plans.scan import Scan

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    plan = profile.source_profile(fx.events(spark, d), NOW, fx.field_types())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
    read, events_of = [], fx.events
    monkeypatch.setattr(fx, "events", lambda *a: read.append(a) or events_of(*a))
    scan = Scan(spark, d)
    for df in (scan.findings, scan.native_verdicts, scan.lag, scan.volume, scan.drift, scan.health):
        assert "events.parquet" not in df._jdf.queryExecution().executedPlan().toString()
    assert len(read) == 1
