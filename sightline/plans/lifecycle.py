"""Queries on findings, policy, scans over time, tenants, metrics, history and advisory evidence."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import advisory, findings, history, profile, resolve, verdicts
from ..sources import tables
from ..sources.shared import shared_dir, written
from . import coverage as cv
from . import fixtures as fx
from .coverage import LEGACY, STARVED
from .fixtures import CATALOG, COUNTERS, EDGES, EV, FIELD_DAYS, LAG_ALL, NOW, NOW1, PAT, RES, RULES, SRC, VOLUME, with_
from .registry import SQL, query
from .scan import Scan, latest_of

us = F.unix_micros
T, T1 = f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{NOW1}'"
SNAP = """snap AS (SELECT source, day AS scan_ts, day(day) % 7 <> 0 AS fetched, list_sort(list(DISTINCT field || '=' || type)) AS f, list_sort(list(DISTINCT field)) AS names FROM field_days GROUP BY source, day),
prevs AS (SELECT *, last_value(CASE WHEN fetched THEN f END IGNORE NULLS) OVER w AS pf, last_value(CASE WHEN fetched THEN names END IGNORE NULLS) OVER w AS pn FROM snap WINDOW w AS (PARTITION BY source ORDER BY scan_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
#: Latest status of each source's volume and schema.
LATEST = """vol AS (SELECT source, arg_max(status, i) AS v, arg_max({'z': z}, i).z AS z FROM fold GROUP BY source),
sch AS (SELECT source, arg_max(CASE WHEN NOT fetched THEN 'unknown' WHEN pf IS NULL THEN 'warming' WHEN f <> pf THEN 'drift' ELSE 'ok' END, scan_ts) AS x FROM prevs GROUP BY source)"""
BASE = (EV, RULES, PAT, EDGES, SRC, STARVED, LEGACY, LAG_ALL, FIELD_DAYS, cv.FIELDS, cv.FROWS, cv.IMPAIRED, RES, COUNTERS, VOLUME, SNAP, LATEST)
FID = "'finding-' || left(sha256(array_to_string(['t', '', 'b', class, rule_id, reason, source, dependency], chr(0))), 20)"
#: Empty selectors of rules of which another selector resolves.
EMPTY_SELECTOR = "p.pattern NOT LIKE '-%' AND p.pattern NOT LIKE '%:%' AND len(list_filter(r.patterns, lambda x: x NOT LIKE '-%')) >= 2 AND r.rule_id IN (SELECT rule_id FROM redges) AND NOT EXISTS (FROM (SELECT DISTINCT source FROM ev) s WHERE s.source LIKE " + fx.LIKE.format(p="p.pattern") + " ESCAPE '\\')"
FINDINGS = f"""fnd AS (SELECT {FID} AS finding_id, * FROM (SELECT 'dead-detection' AS class, reason, rule_id, severity, '' AS source, '' AS dependency FROM legacy WHERE section = 'dead'
  UNION ALL SELECT 'impaired-detection', 'missing-fields', rule_id, severity, source, dependency FROM (SELECT rule_id, source, unnest(missing) AS dependency FROM frows WHERE rule_id IN (SELECT rule_id FROM mf)) JOIN legacy USING (rule_id) WHERE section = 'live'
  UNION ALL SELECT 'impaired-detection', 'lag-blind-window', rule_id, severity, source, '' FROM (SELECT rule_id, unnest(string_split(lag_sources, ',')) AS source FROM lb) JOIN legacy USING (rule_id) WHERE section = 'live'
  UNION ALL SELECT 'source-degraded', status, '', '', source, '' FROM health WHERE status IN ('stale', 'empty')
  UNION ALL SELECT 'volume-low', 'low', '', '', source, '' FROM vol WHERE v = 'low'
  UNION ALL SELECT 'schema-drift', 'drift', '', '', source, '' FROM sch WHERE x = 'drift'
  UNION ALL SELECT 'unused-telemetry', 'unused', '', '', source, '' FROM src WHERE source NOT IN (SELECT source FROM edges JOIN rules USING (rule_id) WHERE enabled)
  UNION ALL SELECT 'partial-input', 'selector-empty', r.rule_id, severity, '', p.pattern FROM pat p JOIN rules r ON r.rule_id = p.rule_id WHERE {EMPTY_SELECTOR}))"""


def findings_of(spark, d):
    return Scan(spark, d).findings


def found_of(spark, d):
    return findings_of(spark, d).select("finding_id", "class", "reason", "rule_id", "source", "dependency")


@query(with_(*BASE, FINDINGS) + "SELECT finding_id, class, reason, rule_id, source, dependency FROM fnd")
def build_findings(spark, d):
    """Findings of all seven classes."""
    return found_of(spark, d)


@query(SQL["build_findings"])
def build_findings_all(spark, d):
    """The same, as before under a name of its own."""
    return found_of(spark, d)


ACCEPT = f"""acc AS (SELECT finding_id, CASE WHEN ascii(right(finding_id, 1)) % 2 = 0 THEN {T} + INTERVAL 1 DAY ELSE {T} - INTERVAL 1 DAY END AS expires_at FROM fnd WHERE ascii(substr(finding_id, 9, 1)) % 3 = 0)"""


def accept_of(f):
    even = F.ascii(F.right("finding_id", F.lit(1))) % 2 == 0
    return f.where(F.ascii(F.substring("finding_id", 9, 1)) % 3 == 0).select("finding_id", F.when(even, F.lit(NOW + timedelta(days=1))).otherwise(F.lit(NOW - timedelta(days=1))).alias("expires_at"))


@query(with_(*BASE, FINDINGS, ACCEPT) + f"SELECT f.finding_id, CASE WHEN expires_at > {T} THEN 'active' WHEN expires_at IS NOT NULL THEN 'expired' ELSE '' END AS acceptance FROM fnd f LEFT JOIN acc USING (finding_id)")
def apply_acceptances(spark, d):
    f = findings_of(spark, d)
    return findings.apply_acceptances(f, accept_of(f), NOW).select("finding_id", F.coalesce("acceptance", F.lit("")).alias("acceptance"))


GATED = f"""gated AS (SELECT f.*, class IN ('dead-detection', 'source-degraded') AND NOT coalesce(expires_at > {T}, false) AND (class = 'source-degraded' OR severity IN ('critical', 'high')) AS gates FROM fnd f LEFT JOIN acc USING (finding_id))"""


def gated_of(spark, d):
    f = findings_of(spark, d)
    return findings.apply_policy(f, ["dead-detection", "source-degraded"], accept_of(f), NOW, "high")


@query(with_(*BASE, FINDINGS, ACCEPT, GATED) + "SELECT finding_id, class, gates FROM gated")
def apply_policy(spark, d):
    return gated_of(spark, d).select("finding_id", "class", "gates")


@query(with_(*BASE, FINDINGS, ACCEPT, GATED) + "SELECT 'tenant-' || (k % 5) AS instance, max(gates::INT) AS code FROM gated JOIN rules USING (rule_id) GROUP BY 1")
def gate_status(spark, d):
    who = fx.rules(spark, d).select("rule_id", F.concat(F.lit("tenant-"), (F.col("k") % 5).cast("string")).alias("instance"))
    f = gated_of(spark, d).join(who, "rule_id")
    return findings.gate_status(who.select("instance").distinct(), f)


@query(with_(*BASE, FINDINGS, ACCEPT, GATED) + "SELECT 'tenant-' || (k % 5) AS instance, CASE WHEN k5 = 1 THEN 2 WHEN k5 = 2 THEN 2 WHEN k5 = 3 THEN 2 ELSE max(gates::INT) END AS code FROM (SELECT *, k % 5 AS k5 FROM gated JOIN rules USING (rule_id)) GROUP BY 1, k5")
def candidate_gate(spark, d):
    """Of five tenants one lacks resolution, one lag, and one has unmapped rules."""
    r = fx.rules(spark, d).withColumn("n5", F.col("k") % 5)
    who = r.select("rule_id", F.concat(F.lit("tenant-"), F.col("n5").cast("string")).alias("instance"), "n5")
    names = F.array(F.struct(F.lit("source_resolution").alias("name"), F.when(F.col("n5") == 1, "incomplete").otherwise("assessed").alias("status")), F.struct(F.lit("ingest_lag").alias("name"), F.when(F.col("n5") == 2, "unavailable").otherwise("assessed").alias("status")))
    checks = who.select("instance", F.inline(names)).distinct()
    unsure = who.where("n5 = 3").groupBy("instance").agg(F.count("*").alias("n"))
    return findings.candidate_gate(gated_of(spark, d).join(who, "rule_id"), checks, unsure)


SCANS = """days AS (SELECT DISTINCT event_ts::DATE::TIMESTAMP AS scan_ts FROM ev), hist AS (SELECT 's' AS scope_id, scan_ts, source AS finding_id FROM days, (SELECT DISTINCT source FROM ev) WHERE (day(scan_ts) + right(source, 2)::INT) % 4 <> 0)"""


def scans_of(spark, d):
    """Each day's scan finds every source but each fourth day."""
    ev = fx.events(spark, d)
    first, last = ev.agg(F.min(F.to_date("event_ts")), F.max(F.to_date("event_ts"))).first()
    days = F.sequence(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp"), F.expr("interval 1 day"))
    rows = ev.select("source").distinct().select(F.lit("s").alias("scope_id"), F.explode(days).alias("scan_ts"), F.col("source").alias("finding_id"))
    return rows.where((F.dayofmonth("scan_ts") + F.substring("finding_id", -2, 2).cast("int")) % 4 != 0)


@query(with_(EV, SCANS, """n AS (SELECT *, dense_rank() OVER (ORDER BY scan_ts) AS n FROM hist), g AS (SELECT *, n - coalesce(lag(n) OVER (PARTITION BY finding_id ORDER BY n), n - 2) AS gap FROM n)""")
  + "SELECT scope_id, finding_id, epoch_us(min(scan_ts)) AS first_seen, epoch_us(max(scan_ts)) AS last_seen, count(*) AS occurrences, max(n) = (SELECT max(n) FROM n) AS active, sum((gap > 1)::INT)::BIGINT AS episodes FROM g GROUP BY ALL")
def finding_lifecycle(spark, d):
    out = findings.finding_lifecycle(scans_of(spark, d))
    return out.withColumns({"first_seen": us("first_seen"), "last_seen": us("last_seen")})


@query(with_(EV, """s AS (SELECT DISTINCT source, right(source, 2)::INT AS n FROM ev)""") + f"""SELECT source AS finding_id, epoch_us(CASE WHEN n % 2 = 0 THEN {T1} ELSE {T} END) AS first_seen, epoch_us(CASE WHEN n % 3 = 0 OR n % 2 = 1 THEN {T} ELSE {T1} END) AS last_seen,
  (CASE WHEN n % 2 = 0 THEN 5 ELSE 0 END + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS occurrences, n % 3 = 0 OR n % 4 <> 0 AS active, CASE WHEN n % 3 <> 0 AND n % 4 = 0 THEN epoch_us({T}) END AS recovered_at FROM s WHERE n % 2 = 0 OR n % 3 = 0""")
def lifecycle_merge(spark, d):
    """Even sources were known, those divisible by three are found now, and those by four confirmed as recovered."""
    s = fx.events(spark, d).select(F.lit("s").alias("scope_id"), F.col("source").alias("finding_id"), F.substring("source", -2, 2).cast("int").alias("n")).distinct()
    state = s.where("n % 2 = 0").select("scope_id", "finding_id", F.lit(NOW1).alias("first_seen"), F.lit(NOW1).alias("last_seen"), F.lit(5).cast("long").alias("occurrences"), F.lit(True).alias("active"), F.lit(None).cast("timestamp").alias("recovered_at"))
    out = findings.lifecycle_merge(state, s.where("n % 3 = 0"), s.where("n % 4 = 0"), NOW)
    return out.select("finding_id", us("first_seen").alias("first_seen"), us("last_seen").alias("last_seen"), "occurrences", "active", us("recovered_at").alias("recovered_at"))


PREV = """diag AS (SELECT p.rule_id, pattern AS dependency, EXISTS (FROM (SELECT DISTINCT source FROM ev) s WHERE s.source LIKE """ + fx.LIKE.format(p="p.pattern") + """ ESCAPE '\\') AS resolved FROM pat p JOIN rules r ON r.rule_id = p.rule_id WHERE p.pattern NOT LIKE '-%' AND len(list_filter(patterns, lambda x: x NOT LIKE '-%')) >= 2),
prev AS (SELECT 'dead-detection' AS class, unnest(['starved', 'disconnected']) AS reason, rule_id, '' AS source, '' AS dependency FROM rules
  UNION ALL SELECT 'impaired-detection', 'missing-fields', rule_id, source, unnest(required_fields) FROM redges JOIN rules USING (rule_id) UNION ALL SELECT 'impaired-detection', 'lag-blind-window', rule_id, source, '' FROM redges
  UNION ALL SELECT 'partial-input', 'selector-empty', rule_id, '', dependency FROM diag
  UNION ALL SELECT c, r, '', source, '' FROM src, (VALUES ('source-degraded', 'stale'), ('volume-low', 'low'), ('schema-drift', 'drift'), ('unused-telemetry', 'unused')) AS k(c, r))"""
CONFIRMED = """nst AS (SELECT rule_id, bool_and(status IN ('stale', 'empty')) AS starved FROM redges JOIN health USING (source) GROUP BY rule_id), cons AS (SELECT source, count(*) AS consumers FROM redges JOIN rules USING (rule_id) WHERE enabled GROUP BY source),
remote AS (SELECT rule_id FROM res WHERE status = 'remote'), alive AS (SELECT rule_id FROM rules JOIN nst USING (rule_id) WHERE enabled AND NOT starved AND rule_id NOT IN (FROM remote))"""


@query(with_(*BASE, PREV, CONFIRMED) + """SELECT p.class, p.reason, p.rule_id, p.source, p.dependency, coalesce(CASE p.class
  WHEN 'dead-detection' THEN p.rule_id NOT IN (FROM remote) AND CASE p.reason WHEN 'starved' THEN p.rule_id IN (FROM alive) ELSE p.rule_id IN (SELECT rule_id FROM redges) END
  WHEN 'impaired-detection' THEN p.rule_id NOT IN (FROM remote) AND CASE p.reason WHEN 'missing-fields' THEN fe.status = 'assessed' AND list_contains(fe.fields, p.dependency) ELSE l.status = 'assessed' AND l.p95_s <= lookback_s - interval_s END
  WHEN 'source-degraded' THEN h.status = 'ok' WHEN 'volume-low' THEN v = 'ok' WHEN 'schema-drift' THEN x = 'ok' WHEN 'unused-telemetry' THEN consumers > 0
  ELSE p.rule_id NOT IN (FROM remote) AND resolved END, false) AS confirmed
  FROM prev p LEFT JOIN rules r ON r.rule_id = p.rule_id LEFT JOIN fe ON fe.source = p.source LEFT JOIN lag l ON l.source = p.source LEFT JOIN health h ON h.source = p.source LEFT JOIN vol ON vol.source = p.source LEFT JOIN sch ON sch.source = p.source LEFT JOIN cons ON cons.source = p.source LEFT JOIN diag ON diag.rule_id = p.rule_id AND diag.dependency = p.dependency""")
def recovery_confirmed(spark, d):
    """Earlier findings of all seven classes on every rule and source, against the whole evidence of this scan."""
    return recovery_of(spark, d)


@query(SQL["recovery_confirmed"])
def recovery_confirmed_all(spark, d):
    """The same, as before under a name of its own."""
    return recovery_of(spark, d)


def recovery_of(spark, d):
    scan = Scan(spark, d)
    s, e, r, res = scan.sources, scan.resolved_edges, scan.rules, scan.resolutions
    row = lambda df, kind, reason, rule="", source="", dependency="": df.select(F.lit(kind).alias("class"), F.lit(reason).alias("reason"), *[(F.col(c) if c else F.lit("")).alias(n) for c, n in ((rule, "rule_id"), (source, "source"), (dependency, "dependency"))])
    wanted = e.join(r.select("rule_id", F.explode("required_fields").alias("field")), "rule_id")
    prev = row(r, "dead-detection", "starved", "rule_id").unionByName(row(r, "dead-detection", "disconnected", "rule_id"))
    for part in (row(wanted, "impaired-detection", "missing-fields", "rule_id", "source", "field"), row(e, "impaired-detection", "lag-blind-window", "rule_id", "source"), row(res.where("diagnostic"), "partial-input", "selector-empty", "rule_id", "", "expression"),
        *[row(s, kind, reason, "", "source") for kind, reason in (("source-degraded", "stale"), ("volume-low", "low"), ("schema-drift", "drift"), ("unused-telemetry", "unused"))]):
        prev = prev.unionByName(part)
    h = scan.health.join(resolve.blast_radius(e, r).select("source", "consumers"), "source", "left")
    out = findings.recovery_confirmed(prev.distinct(), scan.flags, scan.native_verdicts, h, scan.lag, scan.field_rows(e), {"source_resolution": "assessed", "schema_drift": "assessed"}, r, res, "complete")
    return out.select("class", "reason", "rule_id", "source", "dependency", "confirmed")


def old_new_of(spark, d):
    f = gated_of(spark, d)
    last = F.ascii(F.right("finding_id", F.lit(1)))
    old = f.where(last % 3 != 0).withColumn("gates", F.col("gates") & (last % 5 != 0))
    return old, f.where(last % 4 != 0)


OLDNEW = """old AS (SELECT finding_id, class, gates AND ascii(right(finding_id, 1)) % 5 <> 0 AS gates FROM gated WHERE ascii(right(finding_id, 1)) % 3 <> 0), new AS (SELECT finding_id, class, gates FROM gated WHERE ascii(right(finding_id, 1)) % 4 <> 0)"""


@query(with_(*BASE, FINDINGS, ACCEPT, GATED, OLDNEW) + """SELECT * FROM (SELECT coalesce(n.finding_id, o.finding_id) AS finding_id, coalesce(n.class, o.class) AS class, CASE WHEN o.class IS NULL THEN 'new' WHEN n.class IS NULL THEN 'recovered' WHEN NOT o.gates AND n.gates THEN 'newly_gated' WHEN o.gates AND NOT n.gates THEN 'no_longer_gated' END AS change,
  (o.class IS NULL AND n.class NOT IN ('unused-telemetry', 'partial-input')) OR (o.class IS NOT NULL AND n.class IS NOT NULL AND NOT o.gates AND n.gates) AS regression FROM old o FULL OUTER JOIN new n ON o.finding_id = n.finding_id) WHERE change IS NOT NULL""")
def scan_diff(spark, d):
    return findings.scan_diff(*old_new_of(spark, d))


@query(with_(EV) + f"SELECT source, CASE WHEN min(event_ts) >= {T1} THEN 'added' ELSE 'removed' END AS change FROM ev GROUP BY source HAVING min(event_ts) >= {T1} OR max(event_ts) < {T1}")
def source_diff(spark, d):
    ev = fx.events(spark, d)
    return findings.source_diff(ev.where(F.col("event_ts") < F.lit(NOW1)).select("source").distinct(), ev.where(F.col("event_ts") >= F.lit(NOW1)).select("source").distinct())


@query(with_(RULES) + "SELECT rule_id AS scan_key, k % 4 = 0 AS comparable, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'backend differs' WHEN 2 THEN 'include differs' ELSE 'target_id differs' END AS reason FROM rules")
def comparable(spark, d):
    """Scan pairs of which three in four differ in something."""
    k = F.col("k")
    lit = F.lit
    meta = lambda new: fx.rules(spark, d).select(
        F.col("rule_id").alias("scan_key"), lit(1).alias("schema_version"), F.when(lit(new) & (k % 4 == 1), "x").otherwise("b").alias("backend"), lit("").alias("instance"), F.when(lit(new) & (k % 4 == 3), "u").otherwise("t").alias("target_id"), lit(None).cast("string").alias("redaction_key"),
        F.when(lit(new) & (k % 4 == 2), F.array("name")).when(lit(new), F.array(lit("b"), lit("a"))).otherwise(F.array(lit("a"), lit("b"))).alias("include"), F.array().cast("array<string>").alias("exclude"))
    return findings.comparable(meta(False), meta(True))


@query(with_(*BASE, FINDINGS) + "SELECT finding_id AS id, count(*) AS n, 'duplicate' AS problem FROM (SELECT finding_id FROM fnd UNION ALL SELECT finding_id FROM fnd WHERE class = 'dead-detection') GROUP BY 1 HAVING count(*) > 1")
def validate_findings(spark, d):
    f = findings_of(spark, d)
    return resolve.validate_ids(f.select("finding_id").unionByName(f.where("class = 'dead-detection'").select("finding_id")), "finding_id")


TEN = """tsrc AS (SELECT instance, source, count(*) AS docs, sum(size_bytes)::BIGINT AS size_bytes, max(event_ts) AS last_event FROM ev GROUP BY ALL), th AS (SELECT *, CASE WHEN epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_event) > 10800000000 THEN 'stale' ELSE 'ok' END AS status FROM tsrc),
tv AS (SELECT instance, r.rule_id, name, severity, enabled, count(h.source) AS n, bool_and(h.status = 'stale') AS starved, len(list_filter(any_value(patterns), lambda x: x LIKE '%:%')) > 0 AS remote FROM rules r CROSS JOIN (SELECT DISTINCT instance FROM ev) LEFT JOIN (SELECT e.rule_id, th.* FROM edges e JOIN th USING (source)) h USING (rule_id, instance) GROUP BY instance, r.rule_id, name, severity, enabled),
tdead AS (SELECT * FROM tv WHERE enabled AND ((n = 0 AND NOT remote) OR starved))"""


def tenants_of(scan):
    """(health, verdicts) of five tenants at once: the tenant is part of every key."""
    key = F.concat_ws("\0", "instance", "source")
    by = profile.inventory(scan.profile, "instance", "source")
    h = verdicts.source_health(by.withColumn("source", key), NOW, float(fx.MAX_STALE_S)).select(F.split("source", "\0")[0].alias("instance"), F.col("source").alias("key"), F.split("source", "\0")[1].alias("source"), "docs", "size_bytes", "status", "age_s", "lower_bound")
    h = written(h, "tenant-health")
    own = fx.tenant_rules(scan.rules).withColumn("rule_id", F.concat_ws("\0", "instance", "rule_id"))
    edges = scan.edges.join(h.select("instance", "source", "key"), "source").select(F.concat_ws("\0", "instance", "rule_id").alias("rule_id"), F.col("key").alias("source"))
    v = verdicts.rule_verdicts(own, edges, h.select(F.col("key").alias("source"), "status"))
    return h, v.withColumn("instance", F.split("rule_id", "\0")[0]).withColumn("rule_id", F.split("rule_id", "\0")[1])


ROLL = """roll AS (SELECT name AS rule_name, arg_min(severity, instance || CASE severity WHEN 'critical' THEN 'a' WHEN 'high' THEN 'b' WHEN 'low' THEN 'c' ELSE 'd' END) AS severity, count(*) AS dead_in, 0::BIGINT AS impaired_in, 4::BIGINT AS "of" FROM tdead WHERE instance <> 'tenant-3' GROUP BY name)"""


def rollup_of(spark, d):
    h, v = tenants_of(Scan(spark, d))
    inst = h.select("instance").distinct().select("instance", (F.col("instance") != "tenant-3").alias("ok"))
    return findings.fleet_rollup(v, inst)


@query(with_(EV, RULES, PAT, EDGES, TEN, ROLL) + "SELECT * FROM roll")
def fleet_rollup(spark, d):
    return rollup_of(spark, d)


@query(with_(EV, RULES, PAT, EDGES, TEN, ROLL) + "SELECT rule_name, dead_in FROM roll WHERE dead_in >= 2 ORDER BY dead_in DESC, impaired_in DESC, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, rule_name LIMIT 10")
def fleet_repeats(spark, d):
    return findings.repeats(rollup_of(spark, d)).select("rule_name", "dead_in")


@query(with_(EV) + "SELECT CASE WHEN count(DISTINCT user_id % 5) = 5 THEN 'legacy' ELSE 'complete' END AS status FROM ev")
def fleet_unused_assessment(spark, d):
    ev = fx.events(spark, d)
    st = ev.select("instance", F.when(F.col("instance") == "tenant-4", "legacy").otherwise("complete").alias("status")).distinct()
    return findings.fleet_unused_assessment(st, ev.where("instance = 'tenant-9'").select("instance").distinct())


METRICS = """inst AS (SELECT instance, max(event_ts) AS scan_ts, instance <> 'tenant-3' AS ok, CASE instance WHEN 'tenant-4' THEN 'legacy' WHEN 'tenant-2' THEN 'unavailable' ELSE 'complete' END AS unused_status FROM ev GROUP BY instance), good AS (SELECT * FROM inst WHERE ok),
  cons AS (SELECT source, count(DISTINCT rule_id) AS c FROM edges JOIN rules USING (rule_id) WHERE enabled GROUP BY source), own AS (SELECT th.*, coalesce(c, 0) AS c, v, z, x FROM th JOIN good USING (instance) LEFT JOIN cons USING (source) LEFT JOIN vol USING (source) LEFT JOIN sch USING (source)),
  hits AS (SELECT instance, count(DISTINCT rule_id) AS n FROM redges JOIN th USING (source) GROUP BY instance), tres AS (SELECT instance, coalesce(n, 0) AS resolved, (SELECT count(*) FROM local_rules) - coalesce(n, 0) AS empty, (SELECT count(*) FROM res WHERE status = 'remote') AS remote FROM good LEFT JOIN hits USING (instance)),
  m AS (SELECT 'up' AS metric, '' AS instance, bool_and(ok)::INT::DOUBLE AS value FROM inst UNION ALL SELECT 'last_scan_timestamp_seconds', '', max(epoch_us(scan_ts)) // 1000000 FROM inst UNION ALL SELECT 'instance_up', instance, ok::INT FROM inst
  UNION ALL SELECT 'sources', instance, (SELECT count(*) FROM th WHERE th.instance = good.instance AND th.status = s.status) FROM good, (SELECT unnest(['ok', 'stale', 'empty', 'unknown', 'maintenance']) AS status) s
  UNION ALL SELECT s || '_rules', instance, CASE WHEN s = 'dead' THEN (SELECT count(*) FROM tdead WHERE tdead.instance = good.instance) ELSE 0 END FROM good, (SELECT unnest(['dead', 'impaired', 'unmapped']) AS s)
  UNION ALL SELECT 'unused_bytes', instance, coalesce((SELECT sum(size_bytes) FROM own WHERE own.instance = good.instance AND c = 0), 0) FROM good UNION ALL SELECT 'unused_assessed', instance, (unused_status <> 'unavailable')::INT FROM good
  UNION ALL SELECT 'input_resolutions', instance, CASE s WHEN 'resolved' THEN resolved WHEN 'empty' THEN empty WHEN 'remote' THEN remote ELSE 0 END FROM tres, (SELECT unnest(['resolved', 'empty', 'unsupported', 'unavailable', 'remote', 'ambiguous', 'incompatible']) AS s)
  UNION ALL SELECT 'freshness_seconds', instance, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_event)) / 1e6 FROM own UNION ALL SELECT 'consumers', instance, c FROM own UNION ALL SELECT 'volume_zscore', instance, z FROM own WHERE z IS NOT NULL
  UNION ALL SELECT 'volume_low', instance, (v = 'low')::INT FROM own WHERE v IS NOT NULL UNION ALL SELECT 'schema_drift', instance, (x = 'drift')::INT FROM own WHERE x IS NOT NULL)"""

def tenant_resolutions_of(scan, sources, names):
    """instance, status, n: a rule's local selectors resolve in a tenant that has one of their sources."""
    res = scan.resolutions.where("not diagnostic")
    hits = res.select("rule_id", F.explode("resolved_sources").alias("source")).join(sources, "source").groupBy("instance").agg(F.count_distinct("rule_id").alias("hits"))
    # One row of two counts joins to every tenant.
    totals = res.agg(F.count_if(F.col("status").isin("resolved", "empty")).alias("local"), F.count_if(F.col("status") == "remote").alias("remote"))
    all_ = names.join(F.broadcast(totals)).join(hits, "instance", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return all_.select("instance", F.explode(F.create_map(F.lit("resolved"), F.col("hits"), F.lit("empty"), F.col("local") - F.col("hits"), F.lit("remote"), F.col("remote"))).alias("status", "n"))


@query(with_(EV, RULES, PAT, EDGES, RES, TEN, COUNTERS, VOLUME, FIELD_DAYS, SNAP, LATEST, METRICS) + "SELECT metric, instance, count(*) AS n, round(sum(value), 3) AS total FROM m GROUP BY ALL")
def metrics_long(spark, d):
    """Number and sum of each tenant's gauges; one tenant's scan failed."""
    scan, i = Scan(spark, d), F.col("instance")
    h, v = tenants_of(scan)
    last = scan.profile.where("part = 'hour'").groupBy("instance").agg(F.max("last_event").alias("scan_ts"))
    scans = last.withColumns({"ok": i != "tenant-3", "unused_status": F.when(i == "tenant-4", "legacy").when(i == "tenant-2", "unavailable").otherwise("complete")})
    used = resolve.blast_radius(scan.edges, scan.rules).select("source", "consumers")
    baseline = scan.volume.groupBy("source").agg(F.max_by(F.struct(F.col("status").alias("volume_status"), F.col("z").alias("volume_z")), "scan_ts").alias("v")).select("source", "v.*")
    # A row per tenant and source, which several gauges read: computed once.
    whole = written(h.join(used, "source", "left").join(baseline, "source", "left").join(latest_of(scan.drift, "schema_status"), "source", "left"), "gauges")
    unused = whole.where("coalesce(consumers, 0) = 0")
    m = findings.metrics_long(written(scans, "scans"), whole, written(v.select("instance", "section"), "sections"), unused, tenant_resolutions_of(scan, whole.select("instance", "source"), scans.select("instance")))
    return m.groupBy("metric", F.coalesce(F.get_json_object("labels", "$.instance"), F.lit("")).alias("instance")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query(with_(EV, """m AS (SELECT source AS labels, date_trunc('hour', event_ts) AS ts, count(*)::DOUBLE AS value FROM ev GROUP BY ALL), o AS (SELECT *, epoch_us(ts) // 1000000 AS s, value > 1 AS on_ FROM m),
  w AS (SELECT *, max(CASE WHEN NOT on_ THEN s END) OVER p AS off, min(s) OVER p AS start FROM o WINDOW p AS (PARTITION BY labels ORDER BY s))""")
  + "SELECT 'busy' AS alert, labels, epoch_us(ts) AS ts, on_ AND CASE WHEN off IS NULL THEN s - start >= 7200 ELSE s - off > 7200 END AS firing FROM w")
def metric_alerts(spark, d):
    """An alert on hourly counts that stay over 1 for two hours."""
    m = fx.events(spark, d).groupBy(F.col("source").alias("labels"), F.date_trunc("hour", "event_ts").alias("ts")).agg(F.count("*").cast("double").alias("value")).withColumn("metric", F.lit("volume"))
    rules = spark.createDataFrame([("busy", "volume", ">", 1.0, 7200)], "alert string, metric string, op string, threshold double, for_s int")
    return findings.metric_alerts(m, rules).withColumn("ts", us("ts"))


@query(with_(EV) + "SELECT instance, event_type AS name, CASE WHEN count(*) FILTER (event_id % 7 = 0) = count(*) THEN 'unavailable' WHEN count(*) FILTER (event_id % 7 = 0) > 0 THEN 'incomplete' ELSE 'assessed' END AS status, count(*) FILTER (event_id % 7 = 0) AS n_bad FROM ev GROUP BY ALL")
def runtime_assessments(spark, d):
    checks = fx.events(spark, d).select("instance", F.col("event_type").alias("name"), F.when(F.col("event_id") % 7 == 0, "unavailable").otherwise("assessed").alias("status"))
    return findings.runtime_assessments(checks)


@query(with_(EV) + "SELECT DISTINCT instance, event_type AS name FROM ev WHERE event_type NOT IN ('click', 'view')")
def unassessed_checks(spark, d):
    name = F.col("event_type")
    checks = fx.events(spark, d).select("instance", name.alias("name"), F.when(name == "click", "assessed").when(name == "view", "disabled").otherwise("incomplete").alias("status")).distinct()
    return findings.unassessed_checks(checks, ["view"]).select("instance", "name")


@query(with_(EV, SRC) + "SELECT 'slice' AS kind, source AS name FROM health WHERE status = 'stale' UNION ALL SELECT 'run', source FROM src WHERE docs % 5 = 0")
def advisory_warnings(spark, d):
    h = cv.health_of(spark, d)
    runs = h.select(F.col("source").alias("name"), F.lit("assessed").alias("status"), F.when(F.col("docs") % 5 == 0, "Failed").otherwise("Succeeded").alias("run_status"))
    return findings.advisory_warnings(h.select(F.col("source").alias("name"), "status"), runs).select("kind", "name")


@query(with_(*BASE) + "SELECT severity, count(*) AS n, count(DISTINCT rule_id) AS rules FROM legacy WHERE section = 'dead' GROUP BY severity")
def report_tables(spark, d):
    """Dead rules by severity, read back from the nested form of the report."""
    v = verdicts.rule_verdicts(fx.rules(spark, d), cv.edges_of(spark, d), cv.health_of(spark, d)).where("section = 'dead'")
    body = tables.nested_json(v.select("severity", "rule_id", "name", "reason"), "severity", ["rule_id"])
    rows = body.select("severity", F.explode(F.from_json("body", "array<struct<rule_id:string,name:string,reason:string>>")).alias("r"))
    return rows.groupBy("severity").agg(F.count("*").alias("n"), F.count_distinct("r.rule_id").alias("rules"))


@query(with_(EV, COUNTERS) + f"SELECT 'scan-' || (CASE WHEN scan_ts < {T1} THEN 1 ELSE 2 END) AS scan_id, source, max(docs) AS docs FROM counters GROUP BY ALL")
def history_read(spark, d):
    """Counters of two scans written for two targets, and one target's read back."""
    path = shared_dir(spark, "history")
    c = fx.counters(fx.events(spark, d)).select("source", "scan_ts", "docs")
    for target in ("t", "u"):
        tables.write_history(c.where(F.col("scan_ts") < F.lit(NOW1)), path, target, "scan-1")
        tables.write_history(c.where(F.col("scan_ts") >= F.lit(NOW1)), path, target, "scan-2")
    return tables.read_history(spark, path, "t", "source string, scan_ts timestamp, docs long").groupBy("scan_id", "source").agg(F.max("docs").alias("docs"))


@query(with_(EV, COUNTERS) + "SELECT source, count(*) AS n FROM counters WHERE docs % 2 = 0 GROUP BY source")
def history_write(spark, d):
    """A scan that is written again replaces itself."""
    path = shared_dir(spark, "history")
    c = fx.counters(fx.events(spark, d)).select("source", "scan_ts", "docs")
    tables.write_history(c, path, "t", "scan-1")
    tables.write_history(c.where("docs % 2 = 0"), path, "t", "scan-1")
    return tables.read_history(spark, path, "t", "source string, scan_ts timestamp, docs long").groupBy("source").agg(F.count("*").alias("n"))


RATE = """rate AS (SELECT *, CASE WHEN docs >= lag(docs) OVER w AND scan_ts > lag(scan_ts) OVER w THEN (docs - lag(docs) OVER w) / ((epoch_us(scan_ts) - epoch_us(lag(scan_ts) OVER w)) / 3.6e9) END AS rate FROM counters WINDOW w AS (PARTITION BY source ORDER BY scan_ts))"""


@query(with_(EV, COUNTERS, RATE) + "SELECT source, epoch_us(scan_ts) AS scan_ts, docs, round(rate, 6) AS rate FROM rate")
def volume_rate(spark, d):
    return history.volume_rate(fx.counters(fx.events(spark, d))).select("source", us("scan_ts").alias("scan_ts"), "docs", F.round("rate_per_hour", 6).alias("rate"))


@query(with_(EV, COUNTERS, VOLUME) + "SELECT source, epoch_us(scan_ts) AS scan_ts, status, round(rate, 6) AS rate, round(z, 6) AS z, samples FROM fold JOIN steps USING (source, i)")
def volume_baseline(spark, d):
    """Each sample depends on the verdicts before it; SQL carries them from scan to scan."""
    out = history.volume_baseline(fx.counters(fx.events(spark, d)))
    return out.select("source", us("scan_ts").alias("scan_ts"), "status", F.round("rate", 6).alias("rate"), F.round("z", 6).alias("z"), "samples")


SAMPLES = "smp AS (SELECT source, dayofweek(scan_ts) || ':' || hour(scan_ts) AS bucket, rate FROM rate WHERE rate IS NOT NULL)"


def samples_of(spark, d):
    from ..functions.expr import volume_bucket

    return history.volume_rate(fx.counters(fx.events(spark, d))).where("rate_per_hour is not null").select("source", volume_bucket("scan_ts").alias("bucket"), F.col("rate_per_hour").alias("rate"))


@query(with_(EV, COUNTERS, RATE, SAMPLES) + "SELECT source, count(DISTINCT bucket) AS buckets, count(*) AS samples, round(avg(rate), 6) AS mean, round(stddev_pop(rate), 6) AS std FROM smp GROUP BY source")
def baseline_tuning(spark, d):
    return history.baseline_tuning(samples_of(spark, d)).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(with_(EV, COUNTERS, RATE, SAMPLES, "st AS (SELECT source, avg(rate) AS m, stddev_pop(rate) AS s FROM smp GROUP BY source)") + "SELECT CASE WHEN bool_or(m > 0 AND s / m > 0.75) THEN 3 ELSE 2 END AS hysteresis, CASE WHEN bool_or(m > 0 AND s / m > 0.75) THEN 4.0 ELSE 3.0 END::DOUBLE AS z, 4 AS min_samples FROM st")
def tuning_suggestion(spark, d):
    return history.tuning_suggestion(history.baseline_tuning(samples_of(spark, d)))


@query(with_(EV, FIELD_DAYS, SNAP) + """SELECT source, scan_ts::VARCHAR AS scan_day, CASE WHEN NOT fetched THEN 'unknown' WHEN pf IS NULL THEN 'warming' WHEN f <> pf THEN 'drift' ELSE 'ok' END AS status,
  CASE WHEN fetched AND pf IS NOT NULL THEN array_to_string(list_filter(names, lambda x: NOT list_contains(pn, x)), ',') ELSE '' END AS added, CASE WHEN fetched AND pf IS NOT NULL THEN array_to_string(list_filter(pn, lambda x: NOT list_contains(names, x)), ',') ELSE '' END AS removed,
  CASE WHEN fetched AND pf IS NOT NULL THEN array_to_string(list_filter(names, lambda x: list_contains(pn, x) AND len(list_filter(f, lambda y: starts_with(y, x || '=') AND NOT list_contains(pf, y))) > 0), ',') ELSE '' END AS type_changed FROM prevs""")
def schema_drift(spark, d):
    out = drift_of(spark, d)
    return out.select("source", F.col("scan_ts").cast("string").alias("scan_day"), "status", *[F.array_join(c, ",").alias(c) for c in ("added", "removed", "type_changed")])


def drift_of(spark, d):
    days = fx.field_days(fx.events(spark, d))
    types = days.groupBy("source", "day", "field").agg(F.array_sort(F.collect_set("type")).alias("types"))
    snaps = types.groupBy("source", F.col("day").alias("scan_ts")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "types")))).alias("fields"))
    return history.schema_drift(snaps.withColumn("fetched", F.dayofmonth("scan_ts") % 7 != 0))


@query(with_(EV) + f"SELECT user_id FROM ev GROUP BY user_id HAVING coalesce(CASE WHEN user_id % 3 = 0 THEN max(event_ts) END, min(event_ts)) >= {T} - INTERVAL 20 DAY")
def retention_prune(spark, d):
    h = fx.events(spark, d).groupBy("user_id").agg(F.min("event_ts").alias("first_seen"), F.max("event_ts").alias("last"))
    seen = F.when(F.col("user_id") % 3 == 0, F.col("last"))
    return history.retention_prune(h.withColumns({"last_seen": seen, "schema_seen": seen}), NOW, 20).select("user_id")


JOBS = """jobs AS (SELECT rule_id AS job_id, CASE WHEN k % 40 < 2 THEN 'twin-' || (k // 40) ELSE name || k END AS name, [20, 60, 25, 1440][(k % 4)::INT + 1] AS bin_min, (k % 3 * 10)::INT AS delay_min, TIMESTAMP '2024-01-26' + to_hours((k % 100)::INT) AS modified_at, k FROM rules)"""
RUNS = """runs AS (SELECT name, TIMESTAMP '2024-01-24' + to_hours((k % 190)::INT) AS run_at, CASE WHEN k % 6 = 0 THEN 'Failed' ELSE 'Succeeded' END AS run_status, modified_at AS rule_modified_at FROM jobs WHERE k % 11 <> 0)"""


def jobs_of(spark, d):
    k = F.col("k")
    from datetime import datetime

    at = lambda base, hours: F.timestamp_seconds(F.unix_seconds(F.lit(base).cast("timestamp")) + hours * 3600)
    name = F.when(k % 40 < 2, F.concat(F.lit("twin-"), F.floor(k / 40).cast("string"))).otherwise(F.concat("name", k.cast("string")))
    jobs = fx.rules(spark, d).select(F.col("rule_id").alias("job_id"), name.alias("name"), F.element_at(F.array(F.lit(20), F.lit(60), F.lit(25), F.lit(1440)), (k % 4 + 1).cast("int")).alias("bin_min"), (k % 3 * 10).cast("int").alias("delay_min"), at(datetime(2024, 1, 26), k % 100).alias("modified_at"), "k")
    runs = jobs.where(k % 11 != 0).select("name", at(datetime(2024, 1, 24), k % 190).alias("run_at"), F.when(k % 6 == 0, "Failed").otherwise("Succeeded").alias("run_status"), F.col("modified_at").alias("rule_modified_at"))
    return jobs, runs


@query(with_(RULES, JOBS, RUNS, f"""r AS (SELECT name, max({{'a': run_at, 'b': run_status, 'c': rule_modified_at}}) AS r FROM runs WHERE run_at BETWEEN {T} - INTERVAL 7 DAY AND {T} GROUP BY name), n AS (SELECT name, count(*) AS n FROM jobs GROUP BY name)""")
  + f"""SELECT job_id, r.b AS run_status, CASE WHEN n > 1 THEN 'job name is not unique' WHEN bin_min = 25 THEN 'schedule is not supported' WHEN r.a IS NULL THEN 'no run in the window' WHEN r.a < modified_at THEN 'run is older than the definition'
  WHEN r.c > r.a OR epoch_us(r.c) < epoch_us(modified_at) - 30000000 THEN 'run belongs to another definition' WHEN r.b = 'Succeeded' AND (epoch_us({T}) - epoch_us(r.a)) / 1e6 > (bin_min + delay_min) * 60 + 28800 THEN 'last success is too old' ELSE '' END AS detail FROM jobs JOIN n USING (name) LEFT JOIN r USING (name)""")
def job_run_freshness(spark, d):
    return advisory.job_run_freshness(*jobs_of(spark, d), NOW).select("job_id", "run_status", "detail")


@query(with_(RULES, f"""x AS (SELECT rule_id, k, CASE WHEN k % 5 = 0 THEN 'NRT' ELSE 'Scheduled' END AS kind, CASE WHEN k % 5 = 0 THEN 60 ELSE 300 * (1 + k % 4) END AS interval_s, {T} - to_hours((k % 50)::INT) AS modified_at, {T} - to_seconds(((k % 23) * 61)::INT) AS run_at FROM rules)""")
  + f"""SELECT rule_id, CASE WHEN k % 2 = 0 AND NOT ok THEN 'unavailable' ELSE 'resolved' END AS status, k % 2 = 0 AND ok AS proved FROM (SELECT *, k % 9 <> 0 AND run_at >= modified_at AND (epoch_us({T}) - epoch_us(run_at)) / 1e6 <= interval_s + CASE WHEN kind = 'NRT' THEN 120 ELSE 300 END AS ok FROM x)""")
def execution_identity(spark, d):
    k = F.col("k")
    ago = lambda s: F.timestamp_seconds(F.unix_seconds(F.lit(NOW).cast("timestamp")) - s)
    r = fx.rules(spark, d).select("rule_id", "k", F.when(k % 5 == 0, "NRT").otherwise("Scheduled").alias("kind"), F.when(k % 5 == 0, 60).otherwise(300 * (1 + k % 4)).alias("interval_s"), ago(k % 50 * 3600).alias("modified_at"))
    runs = r.select("rule_id", "kind", ago(k % 23 * 61).alias("run_at"), F.when(k % 9 == 0, "Failure").otherwise("Success").alias("status"))
    outcomes = r.select("rule_id", F.lit("x").alias("input"), F.lit("resolved").alias("status"), (k % 2 == 0).alias("needs_proof"))
    return advisory.execution_identity(outcomes, r, runs, NOW).select("rule_id", "status", "proved")


@query(with_(EV, RULES, PAT, EDGES, CATALOG, """j AS (SELECT rule_id AS job_id, k, 'logs-view-' || lpad((k % 12)::VARCHAR, 2, '0') AS output, unnest(['logs-click-' || lpad((k % 12)::VARCHAR, 2, '0'), 'logs-error-01']) AS input FROM rules)""")
  + """SELECT job_id, input, CASE WHEN k % 8 = 0 THEN 'job is not active' WHEN NOT d.provisioned THEN 'destination is not provisioned' WHEN d.plan = 'Basic' THEN 'destination plan is incompatible' WHEN c.plan IS NULL THEN 'input is missing' ELSE '' END AS detail
  FROM j JOIN catalog d ON d."table" = j.output LEFT JOIN catalog c ON c."table" = j.input WHERE output IN (SELECT source FROM edges JOIN rules USING (rule_id) WHERE enabled)""")
def source_lineage(spark, d):
    k = F.col("k")
    name = lambda t: F.concat(F.lit(f"logs-{t}-"), F.lpad((k % 12).cast("string"), 2, "0"))
    jobs = fx.rules(spark, d).select(F.col("rule_id").alias("job_id"), (k % 8 != 0).alias("active"), F.lit("Succeeded").alias("provisioning"), F.lit("").alias("status_code"), F.array(name("click"), F.lit("logs-error-01")).alias("inputs"), F.upper(name("view")).alias("output"))
    used = cv.edges_of(spark, d).join(fx.rules(spark, d).where("enabled").select("rule_id"), "rule_id", "left_semi")
    return advisory.source_lineage(jobs, used, fx.catalog(fx.events(spark, d))).select("job_id", "input", "detail")


@query(with_(RULES) + """SELECT rule_id, CASE WHEN k % 6 = 0 THEN 'rule has no template' WHEN k % 6 = 1 THEN 'template is not installed' WHEN k % 7 = 0 THEN 'package is not installed' WHEN k % 7 = 1 THEN 'package is not in the catalog' WHEN k % 7 < 4 THEN 'installed 1.0; current' ELSE 'installed 1.0; current 2.0' END AS detail FROM rules""")
def rule_provenance(spark, d):
    k = F.col("k")
    r = fx.rules(spark, d)
    t = F.concat(F.lit("/x/T"), k.cast("string"))
    rules = r.select("rule_id", F.when(k % 6 == 0, "").otherwise(t).alias("template"))
    templates = r.where(k % 6 > 1).select(F.lower(t).alias("template"), F.concat(F.lit("p"), (k % 7).cast("string")).alias("package"))
    packages = r.where(k % 7 > 0).select(F.concat(F.lit("P"), (k % 7).cast("string")).alias("package"), F.lit("1.0").alias("version")).distinct()
    catalog = r.where(k % 7 > 1).select(F.concat(F.lit("p"), (k % 7).cast("string")).alias("package"), F.when(k % 7 < 4, "1.0").otherwise("2.0").alias("version")).distinct()
    return advisory.rule_provenance(rules, templates, packages, catalog).select("rule_id", "detail")


@query(with_(RULES, "d AS (SELECT rule_id, 'd' || (k % 3) AS id, n AS name, 'table' AS kind, '' AS scope, true AS monitorable, n = 'a' AS required, k FROM rules, (SELECT unnest(['a', 'b']) AS n))") + "SELECT d.rule_id, d.name, r.name AS rule_name, r.severity, CASE WHEN d.k % 2 = 0 THEN 'supplied' ELSE 'resolved' END AS status FROM d JOIN rules r USING (rule_id)")
def dependency_evidence(spark, d):
    r = fx.rules(spark, d)
    rows = lambda df, status: df.select("rule_id", F.concat(F.lit("d"), (F.col("k") % 3).cast("string")).alias("id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("name"), F.lit("table").alias("kind"), F.lit("").alias("scope"), F.lit(True).alias("monitorable"), F.lit(status).alias("status")).withColumn("required", F.col("name") == "a")
    return resolve.dependency_evidence(rows(r.where("k % 2 = 0"), "supplied"), rows(r, "resolved"), r).select("rule_id", "name", "rule_name", "severity", "status")


