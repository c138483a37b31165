"""Queries on sources, selectors, health and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import evidence, resolve, verdicts
from ..sources import tables
from . import fixtures as fx
from .fixtures import CATALOG, DEPS, EDGES, EV, LAG, MAX_STALE_S, NOW, PAT, RES, RULES, SRC, with_
from .registry import SQL, query

us = F.unix_micros
T = f"TIMESTAMP '{NOW}'"


def sources_of(spark, d):
    return evidence.source_inventory(fx.events(spark, d))


def edges_of(spark, d):
    return resolve.pattern_edges(fx.rules(spark, d), sources_of(spark, d))


def health_of(spark, d, max_stale=MAX_STALE_S):
    return verdicts.source_health(sources_of(spark, d), NOW, float(max_stale))


def resolutions_of(spark, d):
    """Authoritative and diagnostic rows with an order."""
    return resolutions_from(fx.rules(spark, d), sources_of(spark, d))


def resolutions_from(r, s):
    real = resolve.resolve_selectors(r, s).select("rule_id", F.lit(0).alias("ordinal"), F.lit(False).alias("diagnostic"), F.lit("").alias("selector"), "expression", "status", F.lit("").alias("detail"), "resolved_sources")
    diag = resolve.diagnostic_resolutions(r, s).select("rule_id", F.lit(1).alias("ordinal"), F.lit(True).alias("diagnostic"), "selector", "expression", "status", F.lit("").alias("detail"), "resolved_sources")
    return real.unionByName(diag)


def lag_of(spark, d, exact=False):
    ev = fx.events(spark, d)
    return evidence.ingest_lag(ev, evidence.source_inventory(ev), NOW, exact=exact)


@query(with_(EV) + "SELECT source, count(*) AS n, sum(epoch_us(ingest_ts) - epoch_us(event_ts))::BIGINT AS lag_us FROM ev GROUP BY source")
def scan_events(spark, d):
    return fx.events(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum(us("ingest_ts") - us("event_ts")).alias("lag_us"))


@query(with_(EV) + "SELECT source, count(*) AS docs, sum(size_bytes)::BIGINT AS size_bytes, epoch_us(max(event_ts)) AS last_us FROM ev GROUP BY source")
def source_inventory(spark, d):
    return sources_of(spark, d).select("source", "docs", "size_bytes", us("last_event").alias("last_us"))


@query(with_(EV) + "SELECT source, epoch_us(max(event_ts)) AS last_us FROM ev GROUP BY source")
def last_event(spark, d):
    return evidence.last_event(fx.events(spark, d)).select("source", us("last_event").alias("last_us"))


@query(with_(EV) + "SELECT source, n AS docs, CASE WHEN store = 0 THEN total ELSE store END AS size_bytes FROM (SELECT source, count(*) AS n, sum(CASE WHEN right(source, 2)::INT = 3 THEN 0 ELSE size_bytes END)::BIGINT AS store, sum(size_bytes)::BIGINT AS total FROM ev GROUP BY source)")
def backing_rollup(spark, d):
    """Daily partitions of every source, dated or not, rolled up again."""
    ev = fx.events(spark, d)
    dated = F.concat(F.lit(".ds-"), "source", F.lit("-"), F.date_format("event_ts", "yyyy.MM.dd"), F.lit("-000001"))
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(".ds-"), "source", F.lit("-000002"))).otherwise(dated)
    store = F.sum(F.when(F.substring("source", -2, 2) == "03", 0).otherwise(F.col("size_bytes")))
    parts = ev.groupBy(name.alias("name"), "source").agg(F.count("*").alias("docs"), store.alias("store_bytes"), F.sum("size_bytes").alias("total_bytes"))
    return evidence.backing_rollup(parts)


@query(with_(EV, """req AS (SELECT *, CASE right(source, 2)::INT % 3 WHEN 0 THEN 'event_time' WHEN 1 THEN 'ingestion_time' ELSE 'mixed' END AS basis FROM (SELECT DISTINCT source FROM ev))""")
  + f"""SELECT r.source, basis, CASE WHEN basis = 'mixed' THEN 'incomplete' ELSE 'assessed' END AS status,
  epoch_us(CASE basis WHEN 'event_time' THEN max(CASE WHEN event_ts BETWEEN {T} - INTERVAL 24 HOUR AND {T} THEN event_ts END) WHEN 'ingestion_time' THEN max(CASE WHEN ingest_ts BETWEEN {T} - INTERVAL 24 HOUR AND {T} THEN ingest_ts END) END) AS last_us
  FROM req r LEFT JOIN ev ON r.source = ev.source GROUP BY r.source, basis""")  # fmt: skip
def bounded_freshness(spark, d):
    ev = fx.events(spark, d)
    basis = F.element_at(F.array(F.lit("event_time"), F.lit("ingestion_time"), F.lit("mixed")), F.substring("source", -2, 2).cast("int") % 3 + 1)
    req = ev.select("source").distinct().select("source", basis.alias("basis"), F.lit(MAX_STALE_S).alias("max_stale_s"))
    return evidence.bounded_freshness(ev, req, NOW).select("source", "basis", "status", us("last_event").alias("last_us"))


@query(with_(EV) + "SELECT source, event_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ingest_ts DESC, event_id DESC) AS n FROM ev) WHERE n <= 50")
def recent_sample(spark, d):
    return evidence.recent_sample(fx.events(spark, d), 50).select("source", "event_id")


@query(with_(EV, SRC, LAG) + "SELECT source, status, sample_count, round(p95_s, 6) AS p95_s, round(max_s, 6) AS max_s FROM lag")
def ingest_lag(spark, d):
    return lag_of(spark, d).select("source", "status", "sample_count", F.round("p95_s", 6).alias("p95_s"), F.round("max_s", 6).alias("max_s"))


@query("""SELECT source, count(*) AS sample_count, (quantile_disc(lag_ms, 0.95) / 1000)::DOUBLE AS p95_s, (max(lag_ms) / 1000)::DOUBLE AS max_s FROM (
  SELECT 'supp-' || l_suppkey AS source, greatest(0, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) // 1000) AS lag_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY source""")
def ingest_lag_exact(spark, d):
    """Lag of all rows between orders and shipments, clamped at 0."""
    from datetime import datetime, timedelta

    pair = fx.part(spark, d, "lineitem").join(fx.part(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ev = pair.select(F.concat(F.lit("supp-"), "l_suppkey").alias("source"), F.col("l_orderkey").alias("event_id"), F.col("o_orderdate").cast("timestamp").alias("event_ts"), F.col("l_shipdate").cast("timestamp").alias("ingest_ts"))
    # All of history counts, so the day before the scan is stretched over it.
    whole = ev.withColumns({"event_ts": F.col("event_ts") - F.col("ingest_ts") + F.lit(datetime(2030, 1, 1)), "ingest_ts": F.lit(datetime(2030, 1, 1))})
    sources = ev.groupBy("source").agg(F.count("*").alias("docs"))
    return evidence.ingest_lag(whole, sources, datetime(2030, 1, 1) + timedelta(hours=1), exact=True).select("source", "sample_count", "p95_s", "max_s")


@query(with_(EV) + "SELECT DISTINCT source, field, 'long' AS types FROM (SELECT source, unnest(json_keys(props)) AS field FROM ev)")
def schema_snapshot(spark, d):
    return evidence.schema_snapshot(fx.events(spark, d)).select("source", "field", F.array_join("types", ",").alias("types"))


@query(with_(EV, fx.FIELD_DAYS, """n AS (SELECT source, count(DISTINCT day) AS n FROM field_days GROUP BY source), f AS (SELECT source, field, count(DISTINCT day) AS n, bool_and(type <> 'keyword') AS ok FROM field_days GROUP BY ALL)""")
  + "SELECT n.source, w.field, coalesce(f.ok AND f.n = n.n, false) AS available FROM n CROSS JOIN (SELECT unnest(['event_id','host','k','user_id','value_high']) AS field) w LEFT JOIN f ON f.source = n.source AND f.field = w.field")
def field_availability(spark, d):
    days = fx.field_days(fx.events(spark, d))
    rows = days.select("source", F.col("day").alias("partition"), "field", (F.col("type") != "keyword").alias("ok"))
    wanted = fx.rules(spark, d).select(F.explode("required_fields").alias("field")).unionByName(days.select("field").where("field = 'event_id'")).distinct()
    return evidence.field_availability(rows, wanted)


@query(with_(EV, RULES, PAT, EDGES, fx.FIELD_DAYS, """n AS (SELECT source, count(DISTINCT day) AS n FROM field_days GROUP BY source), f AS (SELECT source, field, count(DISTINCT day) AS n, bool_and(type <> 'keyword') AS ok FROM field_days GROUP BY ALL),
  w AS (SELECT DISTINCT source, unnest(required_fields) AS field FROM edges JOIN rules USING (rule_id) WHERE enabled)""")
  + "SELECT n.source, w.field, coalesce(f.ok AND f.n = n.n, false) AS available FROM w JOIN n ON n.source = w.source LEFT JOIN f ON f.source = n.source AND f.field = w.field")
def field_availability_of_rules(spark, d):
    """Only of the fields that enabled rules need from a source."""
    days = fx.field_days(fx.events(spark, d))
    rows = days.select("source", F.col("day").alias("partition"), "field", (F.col("type") != "keyword").alias("ok"))
    needed = fx.rules(spark, d).where("enabled").select("rule_id", F.explode("required_fields").alias("field"))
    return evidence.field_availability(rows, edges_of(spark, d).join(needed, "rule_id").select("source", "field"))


@query(with_(EV, RULES, PAT, EDGES) + "SELECT * FROM edges")
def pattern_edges(spark, d):
    return edges_of(spark, d)


@query(with_(EV) + "SELECT source, source LIKE 'logs-%' AND source LIKE '%-0%' AS a, source LIKE '%click%' AS b, source = 'logs-view-03' AS c FROM (SELECT DISTINCT source FROM ev)")
def wildcard_match(spark, d):
    s = sources_of(spark, d)
    return s.select("source", X.wildcard_match(F.lit("logs-*-0*"), "source").alias("a"), X.wildcard_match(F.lit("*click*"), "source").alias("b"), X.wildcard_match(F.lit("logs-view-03"), "source").alias("c"))


@query(with_(EV, RULES, PAT) + f"SELECT rule_id, bool_or('logs-view-03' LIKE {fx.LIKE.format(p='pattern')} ESCAPE '\\') AS hit FROM pat GROUP BY rule_id")
def match_any(spark, d):
    return fx.rules(spark, d).select("rule_id", X.match_any("patterns", F.lit("logs-view-03")).alias("hit"))


@query(with_(EV) + "SELECT DISTINCT source FROM ev WHERE (source LIKE 'logs-click-%' OR source LIKE '%-05') AND source NOT LIKE '%-00'")
def filter_sources(spark, d):
    return resolve.filter_sources(sources_of(spark, d), ["logs-click-*", "*-05"], ["*-00"]).select("source")


@query(with_(EV, SRC) + "SELECT source, status, source LIKE 'logs-e%' AS listed FROM health")
def scope_listing(spark, d):
    return verdicts.scope_listing(health_of(spark, d), resolve.filter_sources(sources_of(spark, d), ["logs-e*"], [])).select("source", "status", "listed")


@query(with_(RULES, PAT) + "SELECT rule_id, coalesce(string_agg(CASE WHEN pattern NOT LIKE '%:%' THEN pattern END, ',' ORDER BY ordinal), '') AS local, coalesce(string_agg(CASE WHEN pattern LIKE '%:%' THEN pattern END, ',' ORDER BY ordinal), '') AS remote FROM pat GROUP BY rule_id")
def split_selectors(spark, d):
    return resolve.split_selectors(fx.rules(spark, d)).select("rule_id", F.array_join("local", ",").alias("local"), F.array_join("remote", ",").alias("remote"))


@query(with_(RULES) + "SELECT rule_id, p AS selector, p AS expression FROM (SELECT rule_id, unnest(patterns) AS p FROM rules WHERE len(list_filter(patterns, lambda x: x NOT LIKE '-%')) >= 2)")
def diagnostic_selectors(spark, d):
    return resolve.diagnostic_selectors(fx.rules(spark, d))


@query(with_(RULES, PAT) + "SELECT rule_id, string_agg(pattern, ',' ORDER BY ordinal) AS patterns FROM pat GROUP BY rule_id")
def detector_patterns(spark, d):
    """Nested lists with blanks and repeats of the rules' patterns."""
    r = fx.rules(spark, d)
    nested = F.array(F.transform("patterns", lambda p: F.concat(F.lit(" "), p)), F.array(F.lit(" ")), F.col("patterns"))
    return resolve.detector_patterns(r.withColumn("nested", nested), "nested").select("rule_id", F.array_join("patterns", ",").alias("patterns"))


@query(with_(RULES) + """SELECT rule_id, CASE WHEN k % 13 = 0 THEN 'unavailable' WHEN k % 5 = 0 THEN 'unsupported' WHEN k % 5 = 1 THEN 'ambiguous' WHEN k % 3 = 0 THEN 'ambiguous' ELSE '' END AS input_status,
  CASE WHEN k % 13 = 0 THEN false ELSE enabled END AS enabled FROM rules""")
def input_status(spark, d):
    k = F.col("k")
    r = fx.rules(spark, d).withColumns({
        "kind": F.when(k % 5 == 0, "threat_match").when(k % 5 == 1, "esql").otherwise("query"), "data_view": F.when(k % 3 == 0, "view").otherwise(""), "enabled": F.when(k % 13 == 0, None).otherwise(F.col("enabled"))})
    return resolve.input_status(r).select("rule_id", F.coalesce("input_status", F.lit("")).alias("input_status"), "enabled")


@query(with_(RULES, PAT) + """SELECT rule_id, CASE WHEN k % 4 = 3 THEN '' ELSE p END AS inputs, CASE WHEN k % 4 = 3 THEN 'subqueries are not supported' ELSE '' END AS detail
  FROM rules JOIN (SELECT rule_id, string_agg(pattern, '|' ORDER BY ordinal) AS p FROM pat GROUP BY rule_id) USING (rule_id)""")
def declared_inputs(spark, d):
    """Query texts made of the rules' patterns: with comments, quotes, metadata, or a subquery."""
    k, p = F.col("k"), F.array_join("patterns", ", ")
    quoted = F.array_join(F.transform("patterns", lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ",")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("FROM "), p, F.lit(" | WHERE a == 1"))).when(k % 4 == 1, F.concat(F.lit("// note | FROM x\n/* y */ from "), quoted, F.lit(" METADATA _id | LIMIT 1")))
        .when(k % 4 == 2, F.concat(F.lit("from "), p, F.lit("\n| stats count(*)"))).otherwise(F.concat(F.lit("FROM (FROM "), p, F.lit(")"))))
    return resolve.declared_inputs(fx.rules(spark, d).withColumn("query", text)).select("rule_id", F.array_join("inputs", "|").alias("inputs"), F.coalesce("detail", F.lit("")).alias("detail"))


@query(with_(RULES) + "SELECT rule_id, timestamp_override = '' AS by_event FROM rules")
def windows_on_event_time(spark, d):
    return fx.rules(spark, d).select("rule_id", resolve.windows_on_event_time().alias("by_event"))


@query(with_(EV, RULES, PAT, EDGES) + """SELECT source, CASE WHEN bool_or(timestamp_override = '') AND bool_or(timestamp_override <> '') THEN 'mixed' WHEN bool_or(timestamp_override <> '') THEN 'ingestion_time' ELSE 'event_time' END AS basis
  FROM edges JOIN rules USING (rule_id) WHERE enabled GROUP BY source""")
def freshness_clock(spark, d):
    return resolve.freshness_clock(edges_of(spark, d), fx.rules(spark, d))


@query(with_(EV) + "SELECT source FROM ev GROUP BY source HAVING count(*) > 0")
def telemetry_evidence(spark, d):
    return sources_of(spark, d).where(evidence.telemetry_evidence()).select("source")


@query(with_(RULES) + "SELECT CASE WHEN k % 50 = 0 THEN '' ELSE 'r' || (k // 2) END AS id, count(*) AS n, CASE WHEN min(k % 50) = 0 AND bool_and(k % 50 = 0) THEN 'empty' ELSE 'duplicate' END AS problem FROM rules GROUP BY 1 HAVING count(*) > 1 OR id = ''")
def validate_rule_ids(spark, d):
    k = F.col("k")
    ids = fx.rules(spark, d).withColumn("rule_id", F.when(k % 50 == 0, " ").otherwise(F.concat(F.lit(" r"), F.floor(k / 2).cast("string"))))
    return resolve.validate_ids(ids, "rule_id")


@query(with_(EV, RULES, PAT, RES) + "SELECT rule_id, expression, status, resolved FROM res")
def resolve_selectors(spark, d):
    return resolve.resolve_selectors(fx.rules(spark, d), sources_of(spark, d)).select("rule_id", "expression", "status", F.array_join("resolved_sources", ",").alias("resolved"))


@query(with_(EV, RULES) + """SELECT rule_id, string_agg(DISTINCT s, ',' ORDER BY s) AS sources FROM (
  SELECT rule_id, CASE d WHEN 0 THEN 'logs-click-01' WHEN 1 THEN 'logs-view-02' ELSE 'plain-' || (k % 7) END AS s FROM rules, (SELECT unnest([0, 1, 2]) AS d)) GROUP BY rule_id""")
def alias_expand(spark, d):
    ev = fx.events(spark, d)
    s = ev.select("source").distinct()
    aliases = s.where("source = 'logs-click-01'").select(F.lit("clicks").alias("alias"), "source")
    partitions = s.where("source = 'logs-view-02'").select(F.concat(F.lit(".ds-"), "source", F.lit("-1")).alias("partition"), "source")
    names = F.array(F.lit("clicks"), F.lit(".ds-logs-view-02-1"), F.concat(F.lit("plain-"), (F.col("k") % 7).cast("string")))
    return resolve.alias_expand(fx.rules(spark, d).select("rule_id", F.explode(names).alias("name")), aliases, partitions).select("rule_id", F.array_join("sources", ",").alias("sources"))


@query(with_(EV, RULES, PAT, RES) + "SELECT * FROM redges")
def resolved_edges(spark, d):
    s, r = sources_of(spark, d), fx.rules(spark, d)
    return resolve.resolved_edges(resolve.resolve_selectors(r, s), r, s)


@query(with_(EV, RULES, PAT, RES) + "SELECT rule_id, string_agg(DISTINCT source, ',' ORDER BY source) AS targets FROM redges WHERE source LIKE '%-04' GROUP BY rule_id")
def missing_targets(spark, d):
    """Sources that end in 04 taken out of the inventory."""
    s = sources_of(spark, d)
    res = resolve.resolve_selectors(fx.rules(spark, d), s)
    return resolve.missing_targets(res, s.where("source not like '%-04'")).select("rule_id", F.array_join("targets", ",").alias("targets"))


OUTCOMES = """outcomes AS (SELECT d.rule_id, d.input, min(d.ordinal) AS ordinal, bool_or(d.required) AS required, CASE WHEN c.plan IS NULL THEN 'empty' WHEN NOT provisioned THEN 'unavailable' WHEN plan = 'Basic' THEN 'incompatible' ELSE 'resolved' END AS status
  FROM deps d LEFT JOIN catalog c ON c."table" = d.input GROUP BY d.rule_id, d.input, c.plan, c.provisioned)"""


def outcomes_of(spark, d):
    return resolve.dependency_outcomes(fx.rule_deps(fx.rules(spark, d)), fx.catalog(fx.events(spark, d)))


@query(with_(EV, RULES, CATALOG, DEPS, OUTCOMES) + "SELECT rule_id, input, required, status FROM outcomes")
def dependency_outcomes(spark, d):
    return outcomes_of(spark, d).select("rule_id", "input", "required", "status")


@query(with_(EV, RULES, CATALOG, DEPS, OUTCOMES, """f AS (SELECT *, CASE WHEN status = 'unavailable' THEN 1 WHEN required AND status <> 'resolved' THEN 2 WHEN NOT required AND status = 'incompatible' THEN 3 WHEN status = 'resolved' THEN 4 ELSE 6 END AS rk FROM outcomes),
  g AS (SELECT rule_id, arg_min(status, rk * 1000 + ordinal) AS status, string_agg(CASE WHEN status = 'resolved' THEN input END, ',' ORDER BY input) AS s FROM f GROUP BY rule_id)""")
  + "SELECT rule_id, status, CASE WHEN status = 'resolved' THEN s ELSE '' END AS sources FROM g")
def rule_resolution(spark, d):
    return resolve.rule_resolution(outcomes_of(spark, d)).select("rule_id", "status", F.array_join("sources", ",").alias("sources"))


@query(with_(EV, RULES, DEPS) + "SELECT d.rule_id, d.input, CASE WHEN s.source IS NULL THEN 'empty' ELSE 'resolved' END AS status FROM deps d LEFT JOIN (SELECT DISTINCT source FROM ev) s ON lower(s.source) = lower(d.input)")
def watchlist_dependencies(spark, d):
    lookups = fx.events(spark, d).select(F.upper("source").alias("alias")).distinct()
    return resolve.watchlist_dependencies(fx.rule_deps(fx.rules(spark, d)), lookups).select("rule_id", "input", "status")


@query("""WITH j AS (SELECT 'r' || (l_partkey % 200) AS rule_id, s_name AS workspace, CASE WHEN s_suppkey % 37 = 5 THEN NULL ELSE 'n' || s_nationkey END AS region, s_suppkey % 41 = 7 AS unlisted FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
  a AS (SELECT rule_id, count(DISTINCT CASE WHEN NOT unlisted THEN workspace END) AS workspaces, bool_or(unlisted) AS gone, bool_or(NOT unlisted AND region IS NULL) AS noreg, len(list_distinct(list_append(list(CASE WHEN NOT unlisted THEN region END), 'n0'))) AS regions FROM j GROUP BY rule_id)
  SELECT rule_id, workspaces, regions::INT AS regions, CASE WHEN gone THEN 'remote' WHEN workspaces > 19 THEN 'incompatible' WHEN noreg THEN 'unavailable' WHEN regions >= 20 THEN 'incompatible' ELSE 'resolved' END AS status FROM a""")
def cross_workspace_limits(spark, d):
    return workspace_limits_of(spark, d, fx.part(spark, d, "lineitem"))


@query(SQL["cross_workspace_limits"])
def cross_workspace_limits_all(spark, d):
    """Of every row, as cross_workspace_limits is by now."""
    return workspace_limits_of(spark, d, fx.part(spark, d, "lineitem"))


def workspace_limits_of(spark, d, items):
    s = fx.part(spark, d, "supplier")
    deps = items.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat(F.lit("r"), (F.col("l_partkey") % 200).cast("string")).alias("rule_id"), F.col("s_name").alias("workspace"))
    spaces = s.where("s_suppkey % 41 <> 7").select(F.col("s_name").alias("workspace"), F.when(F.col("s_suppkey") % 37 != 5, F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("region"))
    return resolve.cross_workspace_limits(deps, spaces, "n0")


@query(with_(EV, SRC, LAG) + "SELECT s.source, docs, epoch_us(last_event) AS last_us, status AS lag_status, round(p95_s, 6) AS p95_s FROM src s JOIN lag USING (source)")
def source_evidence_attach(spark, d):
    ev = fx.events(spark, d)
    s = evidence.source_inventory(ev)
    fresh = evidence.bounded_freshness(ev, s.select("source", F.lit("mixed").alias("basis"), F.lit(60).alias("max_stale_s")), NOW)
    return evidence.source_evidence_attach(s, fresh, evidence.ingest_lag(ev, s, NOW)).select("source", "docs", us("last_event").alias("last_us"), "lag_status", F.round("p95_s", 6).alias("p95_s"))


def field_evidence_of(spark, d):
    """Fields of each source on its latest day; sources that end in 08 could not be read."""
    days = fx.field_days(fx.events(spark, d))
    fields = days.groupBy("source").agg(F.collect_set("field").alias("fields"))
    return fields.select("source", F.when(F.col("source").endswith("08"), "incomplete").otherwise("assessed").alias("status"), "fields")


FIELDS = "fe AS (SELECT source, CASE WHEN source LIKE '%08' THEN 'incomplete' ELSE 'assessed' END AS status, list(DISTINCT field) AS fields FROM field_days GROUP BY source)"
FROWS = """frows AS (SELECT e.rule_id, e.source, fe.status, CASE WHEN fe.status = 'assessed' THEN list_sort(list_filter(required_fields, lambda x: NOT list_contains(fields, x))) ELSE [] END AS missing
  FROM edges e JOIN rules r ON e.rule_id = r.rule_id JOIN fe ON fe.source = e.source WHERE len(required_fields) > 0)"""


@query(with_(EV, RULES, PAT, EDGES, fx.FIELD_DAYS, FIELDS, FROWS) + "SELECT rule_id, source, status, array_to_string(missing, ',') AS missing FROM frows")
def required_fields(spark, d):
    return verdicts.required_fields(edges_of(spark, d), fx.rules(spark, d), field_evidence_of(spark, d)).select("rule_id", "source", "status", F.array_join("missing", ",").alias("missing"))


IMPAIRED = """mf AS (SELECT rule_id, list_sort(list_distinct(flatten(list(missing)))) AS missing FROM frows GROUP BY rule_id HAVING bool_and(status = 'assessed') AND len(flatten(list(missing))) > 0),
lb AS (SELECT e.rule_id, string_agg(DISTINCT e.source, ',' ORDER BY e.source) AS lag_sources, max(p95_s) AS p95_s FROM edges e JOIN rules r ON e.rule_id = r.rule_id JOIN lag l ON l.source = e.source
  WHERE timestamp_override = '' AND interval_s > 0 AND lookback_s >= interval_s AND l.status = 'assessed' AND p95_s > lookback_s - interval_s GROUP BY e.rule_id),
imp AS (SELECT coalesce(mf.rule_id, lb.rule_id) AS rule_id, concat_ws(',', CASE WHEN missing IS NOT NULL THEN 'missing-fields' END, CASE WHEN lag_sources IS NOT NULL THEN 'lag-blind-window' END) AS reasons,
  coalesce(array_to_string(missing, ','), '') AS missing, coalesce(lag_sources, '') AS lag_sources, p95_s FROM mf FULL OUTER JOIN lb ON mf.rule_id = lb.rule_id)"""


def impaired_of(spark, d):
    e, r = edges_of(spark, d), fx.rules(spark, d)
    return verdicts.rule_impairment(e, r, lag_of(spark, d), verdicts.required_fields(e, r, field_evidence_of(spark, d)))


@query(with_(EV, RULES, PAT, EDGES, SRC, LAG, fx.FIELD_DAYS, FIELDS, FROWS, IMPAIRED) + "SELECT rule_id, reasons, missing, lag_sources, round(p95_s, 6) AS p95_s FROM imp")
def rule_impairment(spark, d):
    return impaired_of(spark, d).select("rule_id", F.array_join("reasons", ",").alias("reasons"), F.array_join("missing_fields", ",").alias("missing"), F.array_join("lag_sources", ",").alias("lag_sources"), F.round("p95_s", 6).alias("p95_s"))


DOWN = """down AS (SELECT DISTINCT source FROM ev WHERE source LIKE 'logs-error-%' OR source LIKE '%-02')"""


def downtime_of(spark, d):
    """Windows over two kinds of sources, one of them open at NOW (a Wednesday at 00:00 UTC)."""
    w = fx.part(spark, d, "nation").where("n_nationkey < 3").select(
        F.element_at(F.array(F.array(F.lit("logs-error-*")), F.array(F.lit("logs-view-*")), F.array(F.lit("*-02"))), F.col("n_nationkey") + 1).alias("patterns"),
        F.element_at(F.array(F.array().cast("array<int>"), F.array(F.lit(3)), F.array(F.lit(2))), F.col("n_nationkey") + 1).alias("days"),
        F.element_at(F.array(F.lit(0), F.lit(1380), F.lit(1380)), F.col("n_nationkey") + 1).alias("start_min"), F.element_at(F.array(F.lit(60), F.lit(120), F.lit(120)), F.col("n_nationkey") + 1).alias("end_min"), F.lit("UTC").alias("tz"))
    return verdicts.downtime_match(sources_of(spark, d), w, NOW)


@query(with_(EV, DOWN) + "SELECT source, source IN (SELECT source FROM down) AS in_downtime FROM (SELECT DISTINCT source FROM ev)")
def downtime_match(spark, d):
    return downtime_of(spark, d)


@query(with_(EV) + "SELECT source, CASE WHEN source LIKE 'logs-e%' THEN 600.0 WHEN source LIKE '%-01' THEN 7200.0 ELSE 10800.0 END::DOUBLE AS max_stale_s FROM (SELECT DISTINCT source FROM ev)")
def max_stale_for(spark, d):
    policy = fx.part(spark, d, "region").where("r_regionkey < 2").select(F.col("r_regionkey").alias("ordinal"), F.when(F.col("r_regionkey") == 0, "logs-e*").otherwise("*-01").alias("pattern"), F.when(F.col("r_regionkey") == 0, 600.0).otherwise(7200.0).alias("max_stale_s"))
    return verdicts.max_stale_for(sources_of(spark, d), policy, MAX_STALE_S)


@query(with_(EV) + "SELECT source, min_by(event_type, event_id) AS event_type FROM ev GROUP BY source")
def first_match(spark, d):
    return resolve.first_match(fx.events(spark, d), ["source"], "event_id", "event_type")


@query(with_(EV) + "SELECT source, event_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY event_ts DESC, event_id DESC) AS n FROM ev) WHERE n = 1")
def latest_run(spark, d):
    return resolve.latest_run(fx.events(spark, d).select("source", "event_ts", "event_id"), ["source"], "event_ts").select("source", "event_id")


@query(with_(EV, RULES, PAT, EDGES) + "SELECT source, count(*) FILTER (enabled) AS consumers, count(*) FILTER (NOT enabled) AS disabled, coalesce(string_agg(CASE WHEN enabled THEN rule_id END, ',' ORDER BY rule_id), '') AS rule_ids FROM edges JOIN rules USING (rule_id) GROUP BY source")
def blast_radius(spark, d):
    return resolve.blast_radius(edges_of(spark, d), fx.rules(spark, d)).select("source", "consumers", "disabled", F.array_join("rule_ids", ",").alias("rule_ids"))


@query(with_(EV, SRC, DOWN) + "SELECT source, CASE WHEN status IN ('stale', 'empty') AND source IN (SELECT source FROM down) THEN 'maintenance' ELSE status END AS status, round(age_s, 6) AS age_s FROM health")
def source_health(spark, d):
    h = verdicts.source_health(sources_of(spark, d), NOW, float(MAX_STALE_S), downtime_of(spark, d))
    return h.select("source", "status", F.round("age_s", 6).alias("age_s"))


STARVED = """st AS (SELECT rule_id, bool_and(status IN ('stale', 'empty')) AS starved, coalesce(string_agg(CASE WHEN status IN ('stale', 'empty') THEN source END, ',' ORDER BY source), '') AS degraded, string_agg(source, ',' ORDER BY source) AS matched
  FROM edges JOIN health USING (source) GROUP BY rule_id)"""


@query(with_(EV, RULES, PAT, EDGES, SRC, STARVED) + "SELECT rule_id, starved, degraded FROM st")
def starved(spark, d):
    return verdicts.starved(edges_of(spark, d), health_of(spark, d)).select("rule_id", "starved", F.array_join("degraded", ",").alias("degraded"))


LEGACY = """legacy AS (SELECT r.rule_id, r.name, r.severity, CASE WHEN len(patterns) = 0 THEN 'unmapped' WHEN st.rule_id IS NULL AND len(list_filter(patterns, lambda x: x LIKE '%:%')) > 0 THEN 'remote' WHEN st.rule_id IS NULL OR starved THEN 'dead' ELSE 'live' END AS section,
  CASE WHEN st.rule_id IS NULL AND len(list_filter(patterns, lambda x: x LIKE '%:%')) > 0 THEN 'remote' WHEN st.rule_id IS NULL THEN 'disconnected' WHEN starved THEN 'starved' ELSE '' END AS reason FROM rules r LEFT JOIN st USING (rule_id) WHERE enabled)"""


@query(with_(EV, RULES, PAT, EDGES, SRC, STARVED, LEGACY) + "SELECT rule_id, name, severity, section, reason FROM legacy")
def rule_verdicts(spark, d):
    """Verdicts from names alone."""
    return verdicts.rule_verdicts(fx.rules(spark, d), edges_of(spark, d), health_of(spark, d)).select("rule_id", "name", "severity", "section", "reason")


#: Resolution without the sources that end in 04, which the inventory then lacks.
FLAGS = """flags AS (SELECT rule_id, bool_or(status = 'resolved') AS has_resolved, bool_or(status = 'empty') AS has_empty, bool_or(status = 'remote') AS remote,
  bool_or(rule_id IN (SELECT rule_id FROM redges WHERE source LIKE '%-04')) AS lost FROM res GROUP BY rule_id)"""


def native_of(spark, d):
    """(flags, edges, health, resolutions) with some resolved targets missing from the inventory."""
    s = sources_of(spark, d)
    kept = s.where("source not like '%-04'")
    res = resolutions_of(spark, d)
    edges = resolve.resolved_edges(res.where("not diagnostic"), fx.rules(spark, d), kept)
    return verdicts.rule_flags(res, kept), edges, verdicts.source_health(kept, NOW, float(MAX_STALE_S)), res


@query(with_(EV, RULES, PAT, RES, FLAGS) + "SELECT rule_id, has_resolved, has_empty, remote, CASE WHEN lost THEN 'ambiguous' ELSE '' END AS uncertain_status, remote OR lost AS uncertain FROM flags")
def rule_flags(spark, d):
    return native_of(spark, d)[0].select("rule_id", "has_resolved", "has_empty", "remote", F.coalesce("uncertain_status", F.lit("")).alias("uncertain_status"), "uncertain")


NATIVE = """nst AS (SELECT rule_id, bool_and(status IN ('stale', 'empty')) AS starved FROM redges JOIN health USING (source) WHERE source NOT LIKE '%-04' GROUP BY rule_id),
v AS (SELECT r.rule_id, name, severity, remote, lost, has_resolved, has_empty, nst.rule_id AS m, starved, imp.reasons FROM rules r JOIN flags f USING (rule_id) LEFT JOIN nst USING (rule_id) LEFT JOIN imp USING (rule_id) WHERE enabled),
native AS (SELECT rule_id, 'remote' AS section, 'remote' AS reason FROM v WHERE remote UNION ALL SELECT rule_id, 'unmapped', 'ambiguous' FROM v WHERE lost
  UNION ALL SELECT rule_id, CASE WHEN m IS NULL AND has_empty THEN 'dead' WHEN m IS NULL THEN 'unmapped' WHEN starved THEN 'dead' WHEN reasons IS NOT NULL THEN 'impaired' ELSE 'live' END,
    CASE WHEN m IS NULL AND has_empty THEN 'disconnected' WHEN m IS NULL THEN 'unsupported' WHEN starved THEN 'starved' ELSE coalesce(reasons, '') END FROM v WHERE NOT remote AND NOT lost)"""


@query(with_(EV, RULES, PAT, RES, FLAGS) + "SELECT p.rule_id, pattern AS selector, pattern AS expression FROM pat p JOIN rules r USING (rule_id) JOIN flags f USING (rule_id) WHERE len(patterns) >= 2 AND pattern NOT LIKE '-%' AND len(list_filter(patterns, lambda x: x NOT LIKE '-%')) >= 2 AND has_resolved AND NOT lost AND NOT remote AND pattern LIKE 'winlog%'")
def partial_coverage(spark, d):
    flags, _, _, res = native_of(spark, d)
    return verdicts.partial_coverage(res, flags)


@query(with_(EV, RULES, SRC) + "SELECT source, size_bytes, 0::BIGINT AS disabled_consumers FROM src WHERE source LIKE '%-1%' OR source LIKE '%click%' UNION ALL SELECT source, size_bytes, (SELECT count(*) FROM rules WHERE NOT enabled) FROM src WHERE source LIKE '%error-00'")
def unused_telemetry(spark, d):
    """Rules that read all but clicks; disabled ones also read one source that no enabled rule does."""
    s, r = sources_of(spark, d), fx.rules(spark, d)
    wanted = r.select("rule_id", F.when(F.col("enabled"), F.array(F.lit("logs-p*"), F.lit("logs-s*"), F.lit("logs-v*"), F.lit("logs-error-01"), *[F.lit(f"logs-error-0{i}") for i in range(2, 10)])).otherwise(F.array(F.lit("logs-error-00"))).alias("patterns"))
    return verdicts.unused_telemetry(s, resolve.pattern_edges(wanted, s), r)


@query(with_(EV, RULES, PAT, RES, FLAGS) + "SELECT CASE WHEN bool_or(lost) THEN 'unavailable' ELSE 'complete' END AS status FROM flags JOIN rules USING (rule_id) WHERE enabled")
def unused_assessment(spark, d):
    _, _, _, res = native_of(spark, d)
    return verdicts.unused_assessment(fx.rules(spark, d), res, sources_of(spark, d).where("source not like '%-04'"))


@query(with_(EV, RULES, PAT, RES) + "SELECT status, count(*) AS n FROM res GROUP BY status")
def resolution_counts(spark, d):
    return verdicts.resolution_counts(resolutions_of(spark, d))


@query(with_(EV, RULES, PAT, EDGES, SRC, STARVED, LEGACY) + """SELECT 'sources' AS counter, count(*) AS n FROM health UNION ALL SELECT 'healthy_sources', count(*) FROM health WHERE status = 'ok' UNION ALL SELECT 'degraded_sources', count(*) FROM health WHERE status IN ('stale', 'empty')
  UNION ALL SELECT 'unknown_sources', 0 UNION ALL SELECT 'maintenance_sources', 0 UNION ALL SELECT 'dead_detections', count(*) FROM legacy WHERE section = 'dead' UNION ALL SELECT 'impaired_detections', 0 UNION ALL SELECT 'unmapped_rules', count(*) FROM legacy WHERE section = 'unmapped'
  UNION ALL SELECT 'remote_rules', count(*) FROM legacy WHERE section = 'remote' UNION ALL SELECT 'rules', count(*) FROM rules UNION ALL SELECT 'enabled_rules', count(*) FROM rules WHERE enabled
  UNION ALL SELECT 'unused_sources', count(*) FROM src WHERE source NOT IN (SELECT source FROM edges JOIN rules USING (rule_id) WHERE enabled) UNION ALL SELECT 'unused_bytes', coalesce(sum(size_bytes), 0)::BIGINT FROM src WHERE source NOT IN (SELECT source FROM edges JOIN rules USING (rule_id) WHERE enabled)""")
def summary_rollup(spark, d):
    s, e, r, h = sources_of(spark, d), edges_of(spark, d), fx.rules(spark, d), health_of(spark, d)
    return verdicts.summary_rollup(h, verdicts.rule_verdicts(r, e, h), r, verdicts.unused_telemetry(s, e, r))


@query(with_(EV, SRC) + "SELECT source, concat_ws(',', CASE WHEN status = 'stale' THEN 'stale' END, CASE WHEN docs % 3 = 0 THEN 'volume low' END, CASE WHEN docs % 4 = 0 THEN 'schema drift' END) AS reasons FROM health WHERE status = 'stale' OR docs % 3 = 0 OR docs % 4 = 0")
def source_attention(spark, d):
    h = health_of(spark, d).withColumns({"volume_status": F.when(F.col("docs") % 3 == 0, "low").otherwise("ok"), "schema_status": F.when(F.col("docs") % 4 == 0, "drift").otherwise("ok")})
    return verdicts.source_attention(h).select("source", F.array_join("reasons", ",").alias("reasons"))


@query(with_(EV, RULES, PAT, EDGES, SRC, STARVED, LEGACY) + "SELECT rule_id, name FROM legacy JOIN rules USING (rule_id, name) WHERE section = 'remote' AND k % 4 <> 0")
def visible_unmapped(spark, d):
    v = verdicts.rule_verdicts(fx.rules(spark, d), edges_of(spark, d), health_of(spark, d)).where("section = 'remote'")
    kinds = fx.rules(spark, d).select("rule_id", F.when(F.col("k") % 4 == 0, "correlation").otherwise("query").alias("rule_type"))
    return verdicts.visible_unmapped(v.join(kinds, "rule_id")).select("rule_id", "name")


@query(with_(RULES) + "SELECT CASE WHEN backend_object_id <> '' THEN backend_object_id ELSE rule_id END AS id, CASE WHEN backend_object_id <> '' THEN rule_id END AS logical_id, name FROM rules")
def report_ids(spark, d):
    r = fx.rules(spark, d)
    return resolve.report_ids(r.select("rule_id", "name"), r)


@query(with_(EV, RULES, PAT, EDGES, SRC, STARVED, LEGACY) + """SELECT rule_id, severity, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS rank FROM legacy WHERE section = 'dead'""")
def rank_severity(spark, d):
    v = verdicts.rule_verdicts(fx.rules(spark, d), edges_of(spark, d), health_of(spark, d)).where("section = 'dead'")
    return verdicts.severity_order(v).select("rule_id", "severity", X.rank_severity("severity").alias("rank"))


@query(with_(EV, SRC) + "SELECT source, round(age_s, 6) AS age_s FROM health ORDER BY age_s DESC, source LIMIT 10")
def stalest_sources(spark, d):
    return health_of(spark, d).orderBy(F.desc("age_s"), "source").limit(10).select("source", F.round("age_s", 6).alias("age_s"))


@query(with_(RULES) + """SELECT rule_id, name, enabled, severity, interval_s, lookback_s FROM rules""")
def scan_rules(spark, d):
    """The rules as an index-pattern inventory, normalised."""
    r = fx.rules(spark, d)
    raw = r.select("rule_id", "name", "enabled", F.upper("severity").alias("severity"), F.col("patterns").alias("index"), F.lit("5m").alias("interval"), F.concat(F.lit("now-"), (F.col("lookback_s") / 60).cast("int").cast("string"), F.lit("m/m")).alias("from"))
    return tables.normalise_rules(raw, "index").select("rule_id", "name", "enabled", "severity", "interval_s", "lookback_s")


@query(with_(RULES) + """SELECT rule_id, name, enabled, severity, array_to_string(patterns, ',') AS patterns FROM rules""")
def scan_rules_detector(spark, d):
    """The rules as detectors with nested fields."""
    r = fx.rules(spark, d)
    inputs = F.array(F.struct(F.col("patterns").alias("indices")), F.struct(F.array(F.lit(" ")).alias("indices")))
    half = F.col("k") % 2 == 0
    raw = r.select(F.col("rule_id").alias("id"), F.when(half, None).otherwise(F.col("name")).alias("name"), "enabled", F.array("severity").alias("severities"), inputs.alias("inputs"),
        F.struct(F.when(half, F.col("name")).alias("name"), F.lit(None).cast("boolean").alias("enabled"), F.lit(None).cast("array<string>").alias("severities"), inputs.alias("inputs")).alias("detector"))
    return tables.normalise_rules(raw, "detector").select("rule_id", "name", "enabled", "severity", F.array_join("patterns", ",").alias("patterns"))


@query(with_(RULES) + "SELECT CASE WHEN k % 3 = 0 THEN rule_id WHEN k % 3 = 1 THEN 'o' || k ELSE name END AS rule_id, true AS enabled FROM rules WHERE k % 20 <> 7")
def scan_candidate_rules(spark, d):
    k = F.col("k")
    raw = fx.rules(spark, d).select(
        F.when(k % 3 == 0, F.col("rule_id")).otherwise("").alias("rule_id"), F.when(k % 3 == 1, F.concat(F.lit("o"), k.cast("string"))).alias("id"), "name", F.lit(False).alias("enabled"), F.when(k % 20 == 7, 1).alias("exported_count"))
    return tables.candidate_rules(raw).select("rule_id", "enabled")


@query(with_(EV, RULES, PAT, EDGES) + f"""SELECT rule_id, source, round(avg(CASE WHEN ((t + lookback_s) // interval_s) * interval_s >= t + lag THEN 1.0 ELSE 0.0 END), 6) AS empirical, round(avg(greatest(0.0, least(1.0, (lookback_s - lag)::DOUBLE / interval_s))), 6) AS closed_form
  FROM edges JOIN rules USING (rule_id) JOIN (SELECT source, epoch_us(event_ts) // 1000000 AS t, greatest(0, (epoch_us(ingest_ts) - epoch_us(event_ts)) // 1000000) AS lag FROM ev) USING (source) GROUP BY ALL""")
def run_coverage(spark, d):
    out = evidence.run_coverage(fx.events(spark, d), edges_of(spark, d), fx.rules(spark, d))
    return out.select("rule_id", "source", F.round("empirical", 6).alias("empirical"), F.round("closed_form", 6).alias("closed_form"))


@query(with_(EV, "raw AS (SELECT time_bucket(INTERVAL 20 MINUTE, event_ts) AS b, source, count(*) AS raw_n, count(*) FILTER (event_id % 97 <> 0) AS rollup_n FROM ev GROUP BY ALL)") + "SELECT epoch_us(b) AS bin, source, raw_n, nullif(rollup_n, 0) AS rollup_n, raw_n = rollup_n AS match FROM raw")
def bin_reconciliation(spark, d):
    """Against a rollup that lost every 97th event."""
    ev = fx.events(spark, d)
    rollup = ev.where("event_id % 97 <> 0").groupBy(F.window("event_ts", "20 minutes").start.alias("bin"), "source").agg(F.count("*").alias("rollup_n"))
    return evidence.bin_reconciliation(ev, rollup, ["source"], 20).withColumn("bin", us("bin"))


@query(with_(EV, RULES, PAT, EDGES) + """SELECT e.rule_id, e.source, epoch_us(max(ev.event_ts)) AS last_us FROM edges e JOIN rules r USING (rule_id) LEFT JOIN ev ON ev.source = e.source AND event_type IN ('click', 'view') AND user_id % 50 = k % 50 GROUP BY ALL""")
def slice_freshness(spark, d):
    return slices_of(spark, d, fx.rules(spark, d))


@query(SQL["slice_freshness"])
def slice_freshness_all(spark, d):
    """Of every rule, as slice_freshness is by now."""
    return slices_of(spark, d, fx.rules(spark, d))


def slices_of(spark, d, r):
    ev = fx.events(spark, d).withColumns({"slot": (F.col("user_id") % 50).cast("string")})
    e = edges_of(spark, d).join(r.select("rule_id", "k"), "rule_id")
    terms = F.array(F.struct(F.lit(0).alias("term_no"), F.lit("event_type").alias("field"), F.array(F.lit("click"), F.lit("view")).alias("values")), F.struct(F.lit(1).alias("term_no"), F.lit("slot").alias("field"), F.array((F.col("k") % 50).cast("string")).alias("values")))
    return evidence.slice_freshness(ev, e.select("rule_id", "source", F.inline(terms)), e, NOW, ["event_type", "slot"]).select("rule_id", "source", us("last_event").alias("last_us"))


@query(with_(EV, "h AS (SELECT source, date_trunc('hour', event_ts) AS hour, count(*) AS n FROM ev GROUP BY ALL), w AS (SELECT *, avg(n) OVER b AS m, stddev_pop(n) OVER b AS s FROM h WINDOW b AS (PARTITION BY source, dayofweek(hour), hour(hour) ORDER BY hour ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING))")
  + "SELECT source, epoch_us(hour) AS hour, n, round(CASE WHEN s > 0 THEN (n - m) / s END, 6) AS z, coalesce(CASE WHEN s > 0 THEN (n - m) / s <= -3 ELSE s = 0 AND m > 0 AND n < m / 2 END, false) AS low FROM w")
def volume_baseline_simple(spark, d):
    return evidence.volume_baseline_simple(fx.events(spark, d)).select("source", us("hour").alias("hour"), "n", F.round("z", 6).alias("z"), "low")
