"""Every query with SQL gives the SQL's rows on the smallest tables; streams equal batches."""

import glob
import itertools
import os

import duckdb
import pytest

from sightline.plans import entry
from sightline.plans.fixtures import NOW  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(cols, found):
    clean = lambda v: round(float(v), 6) if type(v).__name__ in ("Decimal", "float") else v
    return sorted((tuple(clean(r[c]) for c in cols) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(entry.SQL))
def test_query(spark, sql, name):
    df = entry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = sql.sql(entry.SQL[name])
    assert sorted(want.columns) == cols
    want = rows(range(len(cols)), [[r[want.columns.index(c)] for c in cols] for r in want.fetchall()])
    assert rows(cols, [r.asDict() for r in df.collect()]) == want


def test_stream_and_batch_baselines_agree(spark):
    a, b = (sorted(map(str, entry.QUERIES[n](spark, DATA).collect())) for n in ("volume_baseline", "stream_volume_state"))
    assert a == b and a


def test_flagship(spark):
    assert {r.reason for r in entry.dead_rules(spark, DATA, 36 * 3600).collect()} == {"disconnected", "starved"}


def test_scan_goes_on_after_a_failure(spark, tmp_path):
    from sightline.plans.streams import stream_of
    from sightline.streaming.streams import scan_query

    def broken(batch):
        raise RuntimeError("no")

    scan_query(stream_of(spark, DATA), broken, f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    assert [r.up for r in spark.read.parquet(f"{tmp_path}/out/up").collect()] == [0]


def test_history_round_trip(spark, tmp_path):
    from sightline.sources import tables

    path = f"{tmp_path}/history"
    assert tables.read_history(spark, path, "t", "a long").count() == 0
    for n in (1, 2):
        tables.write_history(spark.range(n).selectExpr("id as a"), path, "t", "scan-1")
    tables.write_history(spark.range(3).selectExpr("id as a"), path, "u", "scan-1")
    assert tables.read_history(spark, path, "t", "a long").count() == 2
    tables.write_report({"dead": spark.range(2)}, f"{tmp_path}/report", "s1")
    assert spark.read.parquet(f"{tmp_path}/report/dead").count() == 2


def test_scan_candidate_files(spark, tmp_path):
    from sightline.sources import tables

    (tmp_path / "a.json").write_text('[{"rule_id": "x", "enabled": false}, {"name": "n"}, {"severity": "low"}]')
    assert sorted((r.rule_id, r.enabled) for r in tables.scan_candidate_rules(spark, f"file://{tmp_path}/a.json").collect()) == [("n", True), ("x", True)]


def test_all_rules_and_rows_count(spark, sql):
    """These queries have no filter in SQL or code, with _all in their names or without."""
    q = {n: entry.QUERIES[n](spark, DATA) for n in ("slice_freshness", "slice_freshness_all", "cross_workspace_limits_all", "pattern_edges")}
    key = lambda n: {(r.rule_id, r.source) for r in q[n].collect()}
    assert key("slice_freshness") == key("slice_freshness_all") == key("pattern_edges")
    assert q["cross_workspace_limits_all"].count() == sql.sql("SELECT count(DISTINCT l_partkey % 200) FROM lineitem").fetchall()[0][0]
    assert not any(f in entry.SQL[n] for n in ("slice_freshness", "slice_freshness_all", "cross_workspace_limits", "cross_workspace_limits_all") for f in ("k % 20 = 1", "% 200 < 60"))


def test_late_events_of_all_rules(spark):
    late = {(r.rule_id, r.source, r.hour, r.late) for r in entry.QUERIES["stream_late_events_all"](spark, DATA).collect()}
    same = {(r.rule_id, r.source, r.hour, r.late) for r in entry.QUERIES["stream_late_events"](spark, DATA).collect()}
    assert same == late and len({int(x[0][1:]) % 25 for x in late}) > 1 and "% 25" not in entry.SQL["stream_late_events_all"]


def test_streams_read_a_folder_of_part_files(spark, tmp_path):
    whole = spark.read.parquet(f"{DATA}/events.parquet")
    whole.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    assert sum(r.docs for r in entry.QUERIES["stream_scan"](spark, str(tmp_path)).collect()) == whole.count() > 0
    last = lambda d: sorted(map(tuple, entry.QUERIES["stream_last_event"](spark, d).collect()))
    assert last(str(tmp_path)) == last(DATA) != []


def test_findings_of_all_classes(spark):
    q = lambda n: [r.asDict() for r in entry.QUERIES[n](spark, DATA).collect()]
    got = {(r["class"], r["reason"], r["rule_id"], r["source"], r["dependency"]) for r in q("build_findings_all")}
    latest = lambda n, at: {r["source"]: r["status"] for r in sorted(q(n), key=lambda r: r[at])}
    old = {(r["class"], r["reason"], r["rule_id"], r["source"], "") for r in q("build_findings") if r["class"] in ("dead-detection", "source-degraded", "unused-telemetry")}
    volume, drift = latest("volume_baseline", "scan_ts"), latest("schema_drift", "scan_day")
    dead = {r["rule_id"] for r in q("rule_verdicts") if r["section"] == "dead"}
    enabled = {r["rule_id"] for r in q("rule_verdicts")}
    lacking = {(r["rule_id"], r["source"], f) for r in q("required_fields") for f in r["missing"].split(",") if f}
    want = set(old) | {("volume-low", "low", "", s, "") for s, x in volume.items() if x == "low"} | {("schema-drift", "drift", "", s, "") for s, x in drift.items() if x == "drift"}
    for r in q("rule_impairment"):
        if r["rule_id"] in enabled - dead:
            want |= {("impaired-detection", "missing-fields", *x) for x in lacking if x[0] == r["rule_id"] and "missing-fields" in r["reasons"]}
            want |= {("impaired-detection", "lag-blind-window", r["rule_id"], s, "") for s in r["lag_sources"].split(",") if s}
    assert {x for x in got if x[0] != "partial-input"} == want and {"impaired-detection", "partial-input", "dead-detection"} <= {x[0] for x in got}
    # What is found now is not confirmed as gone; a field that is there is.
    gone = {(r["class"], r["reason"], r["rule_id"], r["source"], r["dependency"]): r["confirmed"] for r in q("recovery_confirmed_all")}
    assert len({x[0] for x in gone}) == 7 and not any(gone[x] for x in got if x in gone and x[0] != "dead-detection")
    assert {x[0] for x, ok in gone.items() if ok} >= {"impaired-detection"}


def test_scores_of_minus_three_are_told_as_in_sql(spark, tmp_path):
    """Hours of four weeks in any order, then one at three deviations below their mean: whether it's low hangs on the last bit."""
    counts = [(*p, 3) for p in sorted(set(itertools.permutations((5, 5, 4, 4))))]
    each = [(user, week, i) for user, weeks in enumerate(counts) for week, n in enumerate(weeks) for i in range(n)]
    values = ",".join(f"({j}, TIMESTAMP '2024-01-01 05:00:00' + INTERVAL {7 * w} DAY + INTERVAL {i} MINUTE, {u}, 'view', 1.0::DOUBLE, '{{}}')" for j, (u, w, i) in enumerate(each))
    con = duckdb.connect()
    con.sql(f"CREATE TABLE events AS SELECT * FROM (VALUES {values}) v(event_id, ts, user_id, event_type, value, props)")
    con.sql(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value, props FROM events) TO '{tmp_path}/events.parquet'")
    got = entry.QUERIES["volume_baseline_simple"](spark, str(tmp_path)).select("source", "hour", "n", "z", "low").collect()
    assert rows(range(5), got) == rows(range(5), con.sql(entry.SQL["volume_baseline_simple"]).fetchall())
    assert {r.z for r in got if r.n == 3} == {-3.0}


def test_unused_telemetry_broadcasts_no_rules(spark):
    """However small the rules' files are: a million rules don't fit the driver."""
    plan = entry.QUERIES["unused_telemetry"](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [rule_id" in plan and "SortMergeJoin [pattern" in plan
    assert "BroadcastHashJoin [rule_id" not in plan and "BroadcastHashJoin [pattern" not in plan


@pytest.mark.parametrize("name", ["stream_late_events", "stream_late_events_all"])
def test_rules_meet_late_events_after_the_stream(spark, tmp_path, monkeypatch, name):
    """What the stream writes doesn't grow with the rules. A rule that is listed twice counts twice; the last event, of no source, moves the watermark."""
    from sightline.plans import streams

    con = duckdb.connect()
    con.sql("""CREATE TABLE events AS SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_minutes((i * 7)::INT) AS ts, CASE WHEN i < 99 THEN i % 10 END::BIGINT AS user_id, ['click','error','view'][i % 3 + 1] AS event_type, 1.0::DOUBLE AS value, '{}' AS props FROM range(100) r(i)
      UNION ALL SELECT 100, TIMESTAMP '2024-01-02', NULL, 'view', 1.0, '{}'""")
    con.sql("""CREATE TABLE part AS SELECT (CASE WHEN i > 40 THEN 3 ELSE i END)::BIGINT AS p_partkey, 'n' AS p_name, 'b' AS p_brand, 'PROMO' AS p_type, (CASE WHEN i <> 7 THEN 5 + 7 * (i % 4) END)::INT AS p_size, 1.0::DOUBLE AS p_retailprice FROM range(44) r(i)""")
    for t in ("events", "part"):
        con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    seen, drained = [], streams.drained
    monkeypatch.setattr(streams, "drained", lambda *a: seen.append(drained(*a)) or seen[-1])
    got = [tuple(r) for r in entry.QUERIES[name](spark, str(tmp_path)).select("rule_id", "source", "hour", "late").collect()]
    assert sorted(got) == sorted(con.sql(entry.SQL[name]).fetchall()) and len(got) > 1000
    assert "rule_id" not in seen[0].columns and seen[0].count() < len(got) / 5
