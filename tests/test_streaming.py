"""Processors with state, the join of two streams and the scan that remembers, over several batches."""

import random
import time
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sightline.operators import history
from sightline.operators import profile as pf
from sightline.sources.shared import shared_dir
from sightline.streaming import streams
from sightline.streaming.memory import FINDINGS, Memory, remembering_scan

T0 = datetime(2024, 1, 1)
EVENT = "source string, event_id long, event_ts timestamp, ingest_ts timestamp, size_bytes long, props string"


def fed(spark, schema, *batches):
    """A stream that gives each list of rows in a batch of its own, and the folder it reads."""
    path = shared_dir(spark, "feed")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)  # files are read in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), path


def drained(df):
    out, at = shared_dir(df.sparkSession, "out"), shared_dir(df.sparkSession, "at")
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def until(spark, query, out, schema, wanted, seconds=60):
    """Rows of a running query's table once there are so many."""
    rows = []
    for _ in range(seconds * 2):
        time.sleep(0.5)
        assert query.exception() is None
        if query.lastProgress is not None:
            rows = spark.read.schema(schema).parquet(out).collect()
        if len(rows) >= wanted:
            break
    return rows


def running(df):
    out, at = shared_dir(df.sparkSession, "out"), shared_dir(df.sparkSession, "at")
    df.sparkSession.createDataFrame([], df.schema).write.parquet(out)
    write = lambda b, _: b.write.mode("append").parquet(out)
    return df.writeStream.foreachBatch(write).option("checkpointLocation", at).trigger(processingTime="500 milliseconds").start(), out


COUNTER = "source string, scan_ts timestamp, docs long, in_downtime boolean"


def test_typed_baseline_equals_the_fold(spark):
    r, rows, docs = random.Random(3), [], defaultdict(int)
    for h in range(24 * 7 * 6):
        for s in ("a", "b", "c"):
            docs[s] += r.choice([100, 101, 99, 100, 5 if s == "b" else 100])
            if r.random() < 0.01:
                docs[s] = 0
            rows.append((s, T0 + timedelta(hours=h), None if r.random() < 0.01 else docs[s], h % 50 == 3))
    cut = [0, 300, 301, 2000, len(rows)]
    stream, path = fed(spark, COUNTER, *[rows[a:b] for a, b in zip(cut, cut[1:])])
    key = lambda df: sorted(map(str, df.collect()))
    options = {"min_samples": 2, "z": 2.0}
    got = drained(streams.volume_state(stream, **options))
    assert key(got) == key(history.volume_baseline(spark.createDataFrame(rows, COUNTER), **options)) and len({x.status for x in got.collect()}) == 6


def test_a_source_that_was_away_begins_anew(spark):
    one = [("a", T0 + timedelta(hours=h), 100 * h, False) for h in range(60)]
    back = [("a", T0 + timedelta(days=40, hours=h), 100 * h, False) for h in range(60)]
    got = drained(streams.volume_state(fed(spark, COUNTER, one, back)[0], min_samples=1)).orderBy("scan_ts").collect()
    assert [x.status for x in got[:60]] == [x.status for x in got[60:]]
    assert got[60].status == "unknown" and got[61].status == "warming" and got[61].samples == 0


def test_state_expires_by_the_clock(spark):
    stream, path = fed(spark, COUNTER, [("a", T0, 1, False), ("a", T0 + timedelta(hours=1), 2, False)])
    df = streams.volume_state(stream, expire_s=3.0)
    q, out = running(df)
    assert len(until(spark, q, out, df.schema, 2)) == 2
    time.sleep(4)
    spark.createDataFrame([("a", T0 + timedelta(hours=2), 3, False)], COUNTER).coalesce(1).write.mode("append").parquet(path)
    rows = sorted(until(spark, q, out, df.schema, 3), key=lambda x: x.scan_ts)
    q.stop()
    assert [x.status for x in rows] == ["unknown", "warming", "unknown"]


def test_silence_is_told_when_the_whole_stream_stops(spark):
    schema = "source string, event_ts timestamp"
    stream, path = fed(spark, schema, [("a", T0), ("a", T0 + timedelta(hours=5)), ("b", T0), ("b", None), ("never", None)])
    df = streams.silence_by_clock(stream, 2)
    q, out = running(df)
    rows = until(spark, q, out, df.schema, 2)
    assert {(x.source, x.last_event) for x in rows} == {("a", T0 + timedelta(hours=5)), ("b", T0)}
    spark.createDataFrame([("b", T0 + timedelta(hours=9))], schema).coalesce(1).write.mode("append").parquet(path)
    rows = until(spark, q, out, df.schema, 3)
    q.stop()
    assert sorted((x.source, x.last_event) for x in rows)[1:] == [("b", T0), ("b", T0 + timedelta(hours=9))]


def test_drift_of_events(spark):
    r, days = random.Random(5), []
    for d in range(8):
        days.append([("s" + str(i % 2), i, T0 + timedelta(days=d, seconds=r.randint(0, 86399)), None, r.randint(0, 9), r.choice("xyz")) for i in range(40)])
    fields = [("size,=x", "long", F.col("size_bytes") > 8), ("p", "text", F.col("props") == "x"), ("p", "long", (F.col("props") == "y") & (F.dayofmonth("event_ts") % 3 == 0)), ("z", "text", (F.col("props") == "z") & (F.dayofmonth("event_ts") > 4))]
    flat = sorted((x for d in days for x in d), key=lambda x: x[2])
    stream, _ = fed(spark, EVENT, *[flat[i : i + 90] for i in range(0, len(flat), 90)])
    got = {(x.source, x.day): (x.status, x.added, x.removed, x.type_changed) for x in drained(streams.drift_of_events(stream, fields, "2 hours")).collect()}
    seen, mark = defaultdict(lambda: defaultdict(set)), flat[-1][2] - timedelta(hours=2)
    for s, _, at, _, size, p in flat:
        for name, kind, ok in (("size,=x", "long", size > 8), ("p", "text", p == "x"), ("p", "long", p == "y" and at.day % 3 == 0), ("z", "text", p == "z" and at.day > 4)):
            if ok:
                seen[s, at.replace(hour=0, minute=0, second=0)][name].add(kind)
    want, before = {}, {}
    for s, day in sorted(seen):
        now, old = seen[s, day], before.get(s)
        parts = (now.keys() - old.keys(), old.keys() - now.keys(), {f for f in now.keys() & old.keys() if now[f] != old[f]}) if old else ((), (), ())
        if day + timedelta(days=1) <= mark:
            want[s, day] = ("warming" if not old else "drift" if any(parts) else "ok", *(",".join(sorted(p)) for p in parts))
        before[s] = now
    assert got == want and {x[0] for x in got.values()} >= {"warming", "drift"}


def test_bins_that_either_stream_lacks_wait_for_both_watermarks(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    event = "source string, event_ts timestamp"
    raw, path = fed(spark, event, [("a", at(1)), ("a", at(2)), ("a", at(25)), ("b", at(45)), ("a", at(600))])
    stored, _ = fed(spark, "bin timestamp, source string, rollup_n long", [(at(0), "a", 2), (at(20), "a", 9), (at(20), "c", 1), (at(60), "a", 4), (at(120), "z", 1)])
    got = {(x.source, x.bin): (x.raw_n, x.rollup_n, x.match) for x in drained(streams.reconciliation(raw, stored, ["source"], 20, "30 minutes")).collect()}
    # The events are far ahead, but the stored counts have only come to 90 minutes.
    assert got == {("a", at(0)): (2, 2, True), ("a", at(20)): (1, 9, False), ("c", at(20)): (None, 1, False), ("b", at(40)): (1, None, False), ("a", at(60)): (None, 4, False)}


def judge(whole, before, now):
    """A source is silent if its last event is over an hour old; it has recovered if it is there and is not."""
    s = pf.inventory(whole)
    old = F.col("last_event") < F.lit(now - timedelta(hours=1))
    about = [F.lit("source-degraded").alias("class"), F.lit("stale").alias("reason"), *[F.lit("").alias(c) for c in ("rule_id", "rule_name", "severity")], F.col("source"), F.lit("").alias("dependency")]
    found = s.where(old).select(F.lit("scan").alias("scope_id"), F.col("source").alias("finding_id"), *about)
    fresh = before.where("active").join(s.where(~old).select("source"), "source", "left_semi").select("scope_id", "finding_id")
    return {"sources": s, "findings": found, "recovered": fresh}


def whole_of(memory, n):
    p = memory.read("state/profile", memory.last_commit(), pf.source_profile(memory.spark.createDataFrame([], EVENT), None, memory.fields).schema)
    return sorted(map(str, p.collect())), sorted(map(str, memory.report("sources", "source string, docs long, size_bytes long, last_event timestamp").collect())), {x.source for x in memory.findings(n).where("active").collect()}


def some_events(n=200):
    r = random.Random(8)
    return [(r.choice("abcd"), i, T0 + timedelta(minutes=3 * i), T0 + timedelta(minutes=3 * i, seconds=r.randint(0, 99)), i % 5, r.choice("xy")) for i in range(n)] + [("old", n, T0, T0, 1, None)]


def fields():
    return [("p", "text", F.col("props") == "x"), ("q", "text", F.col("props").isNotNull())]


def test_a_scan_of_many_batches_equals_one(spark):
    rows = some_events()
    many = Memory(spark, shared_dir(spark, "memory"), fields())
    one = Memory(spark, shared_dir(spark, "memory"), fields())
    stream = fed(spark, EVENT, rows[:50], rows[50:51], rows[51:150], rows[150:])[0]
    remembering_scan(stream, many, judge, shared_dir(spark, "at")).awaitTermination()
    remembering_scan(fed(spark, EVENT, rows)[0], one, judge, shared_dir(spark, "at")).awaitTermination()
    assert many.last_commit() == 3 and one.last_commit() == 0
    assert whole_of(many, 3) == whole_of(one, 0) and whole_of(one, 0)[2] == {"old"}
    assert many._batches("state/profile") == [2, 3]  # older ones are deleted


def test_a_batch_delivered_twice_changes_nothing(spark):
    rows = some_events(60)
    m = Memory(spark, shared_dir(spark, "memory"), fields())
    part = spark.createDataFrame(rows, EVENT)
    silent = spark.createDataFrame([("a", 1000, T0 + timedelta(days=1), T0 + timedelta(days=1), 1, "x")], EVENT)
    back = spark.createDataFrame([("b", 1001, T0 + timedelta(days=1, minutes=1), T0 + timedelta(days=1), 1, "x")], EVENT)
    state = lambda n: (whole_of(m, n), sorted(map(str, m.findings(n).collect())))
    for n, events in enumerate([part, silent, back]):
        m.deliver(judge, events, n)
        once = state(n)
        m.deliver(judge, events, n)
        assert state(n) == once
    known = {x.finding_id: x for x in m.findings(2).collect()}
    assert not known["b"].active and known["b"].recovered_at == T0 + timedelta(days=1, minutes=1) and known["c"].occurrences == 2 and known["c"].active


def test_what_a_failed_scan_saw_is_in_the_next(spark):
    rows = some_events(60)
    m = Memory(spark, shared_dir(spark, "memory"), fields())

    def broken(*_):
        raise RuntimeError("no evidence")

    m.deliver(judge, spark.createDataFrame(rows[:20], EVENT), 0)
    m.deliver(broken, spark.createDataFrame(rows[20:40], EVENT), 1)
    assert m.last_commit() == 0 and [(x.up, x.error) for x in m.read("up", 1, "up int, error string").collect()] == [(0, "no evidence")]
    m.deliver(judge, spark.createDataFrame(rows[40:], EVENT), 2)
    assert sum(x.docs for x in m.report("sources", "source string, docs long").collect()) == len(rows)
    m.deliver(judge, spark.createDataFrame([], EVENT), 3)
    assert m.last_commit() == 3 and m.findings(None).schema == spark.createDataFrame([], FINDINGS).schema
