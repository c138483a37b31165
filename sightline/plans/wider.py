"""Queries on nested fields, sketches, needed sources, patterns that match inside a name, providers, and ordered sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, nested, resolve, sections, sketches
from ..sources import needed
from ..sources.provider import EventsProvider, ProviderScan
from ..sources.shared import written
from . import fixtures as fx
from .coverage import FROWS, IMPAIRED, STARVED
from .fixtures import EDGES, EV, LAG_ALL, PAT, RES, RULES, SRC, with_
from .registry import QUERIES, SQL, query

us = F.unix_micros

NESTED = """nest AS (SELECT source, '{"props":' || props || ',"user":{"id":' || user_id || ',"as":{"kind":"' || event_type || '"}}' ||
  CASE WHEN event_id % 10 = 0 THEN ',"tags":["' || event_type || '",' || value || ',{"n":null}]' WHEN event_id % 7 = 0 THEN ',"tags":' || user_id ELSE '' END || '}' AS j FROM ev)"""


@query(with_(EV, NESTED, """tree AS (SELECT source, regexp_replace(substr(fullkey, 3), '\\[\\d+\\]', '[]', 'g') AS field,
  CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'long' WHEN 'BIGINT' THEN 'long' WHEN 'NULL' THEN 'null' ELSE lower(type) END AS type FROM nest, json_tree(nest.j) WHERE fullkey <> '$')""")
  + "SELECT source, field, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM tree GROUP BY source, field")
def nested_schema(spark, d):
    """Paths and types of nested objects and arrays, made of the events' columns."""
    kind, who, value = F.col("event_type"), F.col("user_id").cast("string"), F.col("value").cast("string")
    tags = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit(',"tags":["'), kind, F.lit('",'), value, F.lit(',{"n":null}]'))).when(F.col("event_id") % 7 == 0, F.concat(F.lit(',"tags":'), who)).otherwise("")
    text = F.concat(F.lit('{"props":'), "props", F.lit(',"user":{"id":'), who, F.lit(',"as":{"kind":"'), kind, F.lit('"}}'), tags, F.lit("}"))
    found = nested.nested_snapshot(fx.events(spark, d).select("source", text.alias("json")), "json")
    return found.select("source", "field", F.array_join("types", ",").alias("types"))


@query(with_(EV) + """SELECT source, epoch_us(date_trunc('week', event_ts)::TIMESTAMP) AS week_us, count(*) AS docs, quantile_disc(greatest(0, (epoch_us(ingest_ts) - epoch_us(event_ts)) // 1000), 0.95)::BIGINT AS lag_ms,
  count(DISTINCT user_id) AS n_values, true AS lag_within, true AS values_within FROM ev GROUP BY ALL""")  # fmt: skip
def lag_sketches(spark, d):
    """Weeks merged from sketches of hours: the exact answers, and whether the sketches' lie within their stated errors.

    The errors are those at 99 % (rank) and one deviation (distinct); the check allows three and five times that.
    """
    keys = ["source", "week"]
    week = lambda c: F.date_trunc("week", c).alias("week")
    ev = fx.events(spark, d)
    hours = sketches.hourly_sketches(ev, "user_id")
    found = written(sketches.estimates(sketches.merged_sketches(hours, "source", week("hour"))), "estimates")
    counts = written(sketches.lag_counts(ev, "source", week("event_ts")), "lags")
    exact = sketches.exact_quantile(counts, *keys).join(sketches.exact_distinct(ev.select("source", week("event_ts"), "user_id"), "user_id", *keys), keys)
    off = sketches.rank_errors(counts, found, *keys)
    joined = exact.join(found.select(*keys, "docs", F.col("n_lags").alias("n_seen"), F.col("n_values").alias("guess")), keys).join(off, keys)
    lag_ok = (F.col("rank_error") <= 3 * sketches.RANK_ERROR) & (F.col("n_seen") == F.col("n_lags"))
    values_ok = F.abs(F.col("guess") - F.col("n_values")) <= F.greatest(F.lit(1.0), 5 * sketches.DISTINCT_ERROR * F.col("n_values"))
    return joined.select("source", us("week").alias("week_us"), "docs", "lag_ms", "n_values", lag_ok.alias("lag_within"), values_ok.alias("values_within"))


def needed_of(rules, sources):
    """source: what the enabled rules resolve to."""
    on = rules.where("enabled")
    return resolve.resolved_edges(resolve.resolve_selectors(on, sources), on, sources).select("source").distinct()


@query(with_(EV, RULES, PAT, RES, "need AS (SELECT DISTINCT source FROM redges JOIN rules USING (rule_id) WHERE enabled)") + "SELECT source, count(*) AS docs, epoch_us(max(event_ts)) AS last_us FROM ev SEMI JOIN need USING (source) GROUP BY source")
def needed_sources(spark, d):
    """Evidence of the sources that enabled rules resolve to, which alone pass the scan."""
    ev = fx.events(spark, d)
    names = ev.select("source").distinct()
    kept = needed.needed_events(ev, needed_of(fx.rules(spark, d), names))
    return evidence.source_inventory(kept).select("source", "docs", us("last_event").alias("last_us"))


INFIX = """pats AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN '*' || lpad((p_partkey % 997)::VARCHAR, 3, '0') || '*' WHEN 1 THEN '*r#*' || (p_partkey % 83) || '*' WHEN 2 THEN '*' || (p_partkey % 10) || '*' || (p_size % 10) || '*' ELSE '*' || p_size || '*' END AS pattern FROM part)"""


@query(with_(INFIX) + f"SELECT pattern, s_name AS source FROM pats JOIN (SELECT DISTINCT s_name FROM supplier) ON s_name LIKE {fx.LIKE.format(p='pattern')} ESCAPE '\\'")
def infix_matches(spark, d):
    """Patterns with ``*`` at both ends against all names of suppliers."""
    k, size, star = F.col("p_partkey"), F.col("p_size"), F.lit("*")
    s = lambda c: c.cast("string")
    pattern = (
        F.when(k % 4 == 0, F.concat(star, F.lpad(s(k % 997), 3, "0"), star)).when(k % 4 == 1, F.concat(F.lit("*r#*"), s(k % 83), star))
        .when(k % 4 == 2, F.concat(star, s(k % 10), star, s(size % 10), star)).otherwise(F.concat(star, s(size), star)))
    return resolve.matches(fx.part(spark, d, "part").select(pattern.alias("pattern")), fx.part(spark, d, "supplier").select(F.col("s_name").alias("source")))


@query(with_(EV, RULES, PAT, EDGES, SRC, LAG_ALL, STARVED, "fe AS (SELECT source, 'assessed' AS status, ['k'] AS fields FROM src)", FROWS, IMPAIRED)
  + """SELECT r.rule_id, r.severity, CASE WHEN len(patterns) = 0 THEN 'unmapped' WHEN st.rule_id IS NULL AND len(list_filter(patterns, lambda x: x LIKE '%:%')) > 0 THEN 'remote' WHEN st.rule_id IS NULL OR starved THEN 'dead' WHEN imp.rule_id IS NOT NULL THEN 'impaired' ELSE 'live' END AS section,
  CASE WHEN st.rule_id IS NULL AND len(list_filter(patterns, lambda x: x LIKE '%:%')) > 0 THEN 'remote' WHEN st.rule_id IS NULL THEN 'disconnected' WHEN starved THEN 'starved' ELSE coalesce(imp.reasons, '') END AS reason
  FROM rules r LEFT JOIN st USING (rule_id) LEFT JOIN imp USING (rule_id) WHERE enabled""")  # fmt: skip
def provider_verdicts(spark, d):
    """A whole scan of the default provider, with fields from the events' JSON."""
    scan = ProviderScan(EventsProvider(fx.events(spark, d), fx.rules(spark, d), fx.NOW, "props"), fx.NOW, fx.MAX_STALE_S)
    return scan.verdicts.select("rule_id", "severity", "section", "reason")


@query(with_(EV, RULES, PAT, RES) + "SELECT row_number() OVER (ORDER BY rule_id, status, expression) AS place, rule_id, status, expression FROM res")
def ordered_resolutions(spark, d):
    rows = resolve.resolve_selectors(fx.rules(spark, d), fx.events(spark, d).select("source").distinct())
    return sections.placed(rows.withColumns({"selector": F.lit(""), "diagnostic": F.lit(False)}), "resolutions").select("place", "rule_id", "status", "expression")


@query(SQL["rule_verdicts"].replace("SELECT rule_id, name, severity, section, reason FROM legacy", "SELECT row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, name, rule_id) AS place, rule_id, severity FROM legacy WHERE section = 'dead'"))
def ordered_dead_rules(spark, d):
    return sections.placed(QUERIES["rule_verdicts"](spark, d).where("section = 'dead'"), "dead").select("place", "rule_id", "severity")


@query(SQL["partial_coverage"].replace("SELECT p.rule_id, pattern", "SELECT row_number() OVER (ORDER BY p.rule_id, pattern) AS place, p.rule_id, pattern"))
def ordered_partial_inputs(spark, d):
    return sections.placed(QUERIES["partial_coverage"](spark, d), "partial")
