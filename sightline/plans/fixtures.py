"""Telemetry, rules and scans derived from the given tables, for queries over them at any size."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scan_events

NOW = datetime(2024, 1, 31)
NOW1 = datetime(2024, 1, 20)
MAX_STALE_S = 3 * 3600
TYPES = ["click", "error", "purchase", "signup", "view"]
FIELDS = ["event_id", "ts", "user_id", "k", "value_high", "host"]


def part(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, value, props, event_type, source, event_ts, ingest_ts, size_bytes, instance."""
    source = "concat('logs-', event_type, '-', lpad(cast(user_id % 10 as string), 2, '0'))"
    late = F.expr("cast(ts as timestamp) + make_dt_interval(0, 0, 0, (event_id * 37) % (60 * (1 + (user_id % 10) * 3)))")
    df = scan_events(spark, f"{sf_dir}/events.parquet", source, "ts", late, columns=("event_id", "user_id", "value", "props", "event_type"))
    return df.withColumns({"size_bytes": F.octet_length("props").cast("long") + 40, "instance": F.concat(F.lit("tenant-"), (F.col("user_id") % 5).cast("string"))})


EV = """ev AS (SELECT event_id, user_id, value, props, event_type, 'logs-' || event_type || '-' || lpad((user_id % 10)::VARCHAR, 2, '0') AS source, ts AS event_ts,
  ts + to_seconds((event_id * 37) % (60 * (1 + (user_id % 10) * 3))) AS ingest_ts, octet_length(encode(props)) + 40 AS size_bytes, 'tenant-' || (user_id % 5) AS instance FROM events)"""


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part(spark, sf_dir, "part")
    x = F.concat(F.lit("0"), (F.col("p_partkey") % 10).cast("string"))
    et = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("p_partkey") % 5 + 1).cast("int"))
    one = F.concat(F.lit("logs-"), et, F.lit("-"), x)
    kinds = [
        F.array(F.lit("netflow-*")), F.array(one), F.array(F.concat(F.lit("logs-"), et, F.lit("-*"))), F.array(F.concat(F.lit("*-"), x)), F.array(one, F.lit("winlog-*")),
        F.array(F.lit("logs-*"), F.concat(F.lit("-logs-"), et, F.lit("-*"))), F.array(F.lit("cluster1:logs-*"))]
    patterns = F.element_at(F.array(*kinds), (F.col("p_size") % 7 + 1).cast("int"))
    k = F.col("p_partkey")
    fields = F.when(k % 3 == 0, F.array(F.lit("user_id"), F.lit("value_high"))).when(k % 3 == 1, F.array(F.lit("k"), F.lit("host"))).otherwise(F.array().cast("array<string>"))
    return p.select(
        F.concat(F.lit("r"), k.cast("string")).alias("rule_id"), F.col("p_name").alias("name"), (k % 10 != 0).alias("enabled"),
        F.when(F.col("p_type").startswith("PROMO"), "critical").when(F.col("p_type").startswith("LARGE"), "high").when(F.regexp_like("p_type", F.lit("^(MEDIUM|STANDARD)")), "medium").otherwise("low").alias("severity"),
        F.lit(300).cast("long").alias("interval_s"), (60 * (6 + F.col("p_size") % 10)).cast("long").alias("lookback_s"), patterns.alias("patterns"),
        F.when(k % 7 == 0, "ingest_ts").otherwise("").alias("timestamp_override"), fields.alias("required_fields"),
        F.when(k % 4 == 0, F.concat(F.lit("obj-"), k.cast("string"))).otherwise("").alias("backend_object_id"), k.alias("k"))


def tenant_rules(r: DataFrame) -> DataFrame:
    """Each of the five tenants has all rules."""
    return r.withColumn("instance", F.explode(F.array(*[F.lit(f"tenant-{i}") for i in range(5)])))


RULES = """rules AS (SELECT 'r' || p_partkey AS rule_id, p_name AS name, p_partkey % 10 <> 0 AS enabled,
  CASE WHEN p_type LIKE 'PROMO%' THEN 'critical' WHEN p_type LIKE 'LARGE%' THEN 'high' WHEN p_type LIKE 'MEDIUM%' OR p_type LIKE 'STANDARD%' THEN 'medium' ELSE 'low' END AS severity,
  300::BIGINT AS interval_s, (60 * (6 + p_size % 10))::BIGINT AS lookback_s,
  CASE p_size % 7 WHEN 0 THEN ['netflow-*'] WHEN 1 THEN ['logs-' || et || '-' || x] WHEN 2 THEN ['logs-' || et || '-*'] WHEN 3 THEN ['*-' || x]
    WHEN 4 THEN ['logs-' || et || '-' || x, 'winlog-*'] WHEN 5 THEN ['logs-*', '-logs-' || et || '-*'] ELSE ['cluster1:logs-*'] END AS patterns,
  CASE WHEN p_partkey % 7 = 0 THEN 'ingest_ts' ELSE '' END AS timestamp_override,
  CASE p_partkey % 3 WHEN 0 THEN ['user_id', 'value_high'] WHEN 1 THEN ['k', 'host'] ELSE [] END AS required_fields,
  CASE WHEN p_partkey % 4 = 0 THEN 'obj-' || p_partkey ELSE '' END AS backend_object_id, p_partkey AS k
  FROM (SELECT *, ['click','error','purchase','signup','view'][(p_partkey % 5)::INT + 1] AS et, '0' || (p_partkey % 10) AS x FROM part))"""

#: Sources of the events, with their health at NOW.
SRC = f"""src AS (SELECT source, count(*) AS docs, sum(size_bytes)::BIGINT AS size_bytes, max(event_ts) AS last_event FROM ev GROUP BY source),
health AS (SELECT source, docs, size_bytes, CASE WHEN docs = 0 THEN 'empty' WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_event) > {MAX_STALE_S}::BIGINT * 1000000 THEN 'stale' ELSE 'ok' END AS status,
  (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_event)) / 1e6 AS age_s FROM src)"""
PAT = """pat AS (SELECT rule_id, unnest(patterns) AS pattern, generate_subscripts(patterns, 1) - 1 AS ordinal FROM rules)"""
LIKE = """replace(replace(replace(replace({p}, '\\', '\\\\'), '%', '\\%'), '_', '\\_'), '*', '%')"""
EDGES = f"""edges AS (SELECT DISTINCT rule_id, source FROM pat JOIN (SELECT DISTINCT source FROM ev) ON source LIKE {LIKE.format(p="pattern")} ESCAPE '\\')"""
#: Native resolution: positives without exclusions; remote selectors apart.
RES = f"""pos AS (SELECT DISTINCT rule_id, source FROM pat JOIN (SELECT DISTINCT source FROM ev) ON source LIKE {LIKE.format(p="pattern")} ESCAPE '\\' WHERE pattern NOT LIKE '-%' AND pattern NOT LIKE '%:%'),
neg AS (SELECT DISTINCT rule_id, source FROM pat JOIN (SELECT DISTINCT source FROM ev) ON source LIKE {LIKE.format(p="substr(pattern, 2)")} ESCAPE '\\' WHERE pattern LIKE '-%'),
redges AS (SELECT * FROM pos EXCEPT SELECT * FROM neg),
local_rules AS (SELECT rule_id, string_agg(pattern, ',' ORDER BY ordinal) AS expression FROM pat WHERE pattern NOT LIKE '%:%' GROUP BY rule_id),
res AS (SELECT l.rule_id, expression, CASE WHEN count(source) = 0 THEN 'empty' ELSE 'resolved' END AS status, coalesce(string_agg(source, ',' ORDER BY source), '') AS resolved
    FROM local_rules l LEFT JOIN redges e ON l.rule_id = e.rule_id GROUP BY ALL
  UNION ALL SELECT rule_id, string_agg(pattern, ',' ORDER BY ordinal), 'remote', '' FROM pat WHERE pattern LIKE '%:%' GROUP BY rule_id)"""
#: 24-hour lag of the 500 events ingested last.
LAG = f"""lagged AS (SELECT source, greatest(0, (epoch_us(ingest_ts) - epoch_us(event_ts)) // 1000) AS lag_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY ingest_ts DESC, event_id DESC) AS n FROM ev WHERE ingest_ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND TIMESTAMP '{NOW}') WHERE n <= 500),
lag AS (SELECT src.source, CASE WHEN src.docs = 0 THEN 'disabled' WHEN count(lag_ms) = 0 THEN 'incomplete' ELSE 'assessed' END AS status, count(lag_ms) AS sample_count,
  quantile_disc(lag_ms, 0.95) / 1000 AS p95_s, max(lag_ms) / 1000 AS max_s FROM src LEFT JOIN lagged ON src.source = lagged.source GROUP BY src.source, src.docs)"""


#: The same of all events of the 24 hours.
LAG_ALL = LAG.replace(" WHERE n <= 500", "")


def with_(*ctes: str) -> str:
    return f"WITH {'RECURSIVE ' * (VOLUME in ctes)}" + ",\n".join(ctes) + "\n"


def field_days(ev: DataFrame) -> DataFrame:
    """source, day, field, type: fields observed each day; one comes and goes, one changes its type."""
    day = F.to_date("event_ts")
    d = F.dayofmonth("event_ts")
    rows = ev.select("source", day.alias("day"), F.explode(F.array(
        F.struct(F.lit("event_id").alias("field"), F.lit("long").alias("type")), F.struct(F.lit("ts").alias("field"), F.lit("date").alias("type")),
        F.struct(F.lit("user_id").alias("field"), F.when(d % 9 == 0, "keyword").otherwise("long").alias("type")),
        F.struct(F.when(F.col("value") > 100, F.lit("value_high")).alias("field"), F.lit("double").alias("type")),
        F.struct(F.when(d % 5 != 0, F.lit("k")).alias("field"), F.lit("long").alias("type")))).alias("f"))
    return rows.where("f.field is not null").select("source", "day", "f.field", "f.type").distinct()


def field_types() -> list[tuple[str, str, Column]]:
    """The same fields and types as conditions on an event."""
    d = F.dayofmonth("event_ts")
    always = F.lit(True)
    return [("event_id", "long", always), ("ts", "date", always), ("user_id", "keyword", d % 9 == 0), ("user_id", "long", d % 9 != 0), ("value_high", "double", F.col("value") > 100), ("k", "long", d % 5 != 0)]


FIELD_DAYS = """field_days AS (SELECT DISTINCT source, event_ts::DATE AS day, f.field AS field, f.type AS type FROM (
  SELECT source, event_ts, unnest([{'field': 'event_id', 'type': 'long'}, {'field': 'ts', 'type': 'date'}, {'field': 'user_id', 'type': CASE WHEN day(event_ts) % 9 = 0 THEN 'keyword' ELSE 'long' END},
    {'field': CASE WHEN value > 100 THEN 'value_high' END, 'type': 'double'}, {'field': CASE WHEN day(event_ts) % 5 <> 0 THEN 'k' END, 'type': 'long'}]) AS f FROM ev) WHERE f.field IS NOT NULL)"""


def counters(ev: DataFrame) -> DataFrame:
    """Cumulative documents of each source at the end of each hour with events: source, scan_ts, docs, in_downtime."""
    from pyspark.sql import Window

    hourly = ev.groupBy("source", F.date_trunc("hour", "event_ts").alias("h")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("source").orderBy("h"))
    scan = F.col("h") + F.expr("interval 1 hour")
    return hourly.select("source", scan.alias("scan_ts"), total.alias("docs"), (F.hour(scan) == 3).alias("in_downtime"))


COUNTERS = """counters AS (SELECT source, h + INTERVAL 1 HOUR AS scan_ts, (sum(n) OVER (PARTITION BY source ORDER BY h))::BIGINT AS docs, hour(h + INTERVAL 1 HOUR) = 3 AS in_downtime FROM (
  SELECT source, date_trunc('hour', event_ts) AS h, count(*) AS n FROM ev GROUP BY ALL))"""


#: Verdict of each scan in order: what was accepted so far (rates by bucket) and the streak of low ones are carried from scan to scan.
VOLUME = """steps AS MATERIALIZED (SELECT source, scan_ts, in_downtime, epoch_us(scan_ts) / 1e6 AS ts, dayofweek(scan_ts) || ':' || hour(scan_ts) AS bucket, row_number() OVER w AS i, first_value(epoch_us(scan_ts) / 1e6) OVER w AS first_ts,
  CASE WHEN docs >= lag(docs) OVER w AND scan_ts > lag(scan_ts) OVER w THEN (docs - lag(docs) OVER w)::DOUBLE * 3600 / (epoch_us(scan_ts) / 1e6 - lag(epoch_us(scan_ts) / 1e6) OVER w) END AS rate FROM counters WINDOW w AS (PARTITION BY source ORDER BY scan_ts)),
fold AS (SELECT source, i, 0 AS streak, []::STRUCT(b VARCHAR, r DOUBLE)[] AS accepted, 'unknown' AS status, NULL::DOUBLE AS z, NULL::INT AS samples FROM steps WHERE i = 1
  UNION ALL SELECT source, i, CASE kind WHEN 'unknown' THEN 0 WHEN 'few' THEN 0 WHEN 'judged' THEN CASE WHEN low THEN streak + 1 ELSE 0 END ELSE streak END,
    CASE WHEN kind IN ('unknown', 'maintenance') OR low THEN accepted ELSE list_append(accepted, {'b': bucket, 'r': rate}) END,
    CASE kind WHEN 'judged' THEN CASE WHEN NOT low THEN 'ok' WHEN streak + 1 >= 2 THEN 'low' ELSE 'pending' END WHEN 'few' THEN 'warming' ELSE kind END, z, CASE WHEN kind IN ('warming', 'few', 'judged') THEN n END
  FROM (SELECT *, kind = 'judged' AND CASE WHEN std > 0 THEN z <= -3 ELSE mean > 0 AND rate < mean * 0.5 END AS low FROM (SELECT *, CASE WHEN kind = 'judged' AND std > 0 THEN (rate - mean) / std END AS z
    FROM (SELECT *, sqrt(list_sum(list_transform(xs, lambda x: (x - mean) * (x - mean))) / n) AS std FROM (SELECT *, list_sum(xs) / n AS mean,
      CASE WHEN rate IS NULL THEN 'unknown' WHEN in_downtime THEN 'maintenance' WHEN ts - first_ts < 86400 THEN 'warming' WHEN n < 4 THEN 'few' ELSE 'judged' END AS kind FROM (SELECT *, len(xs) AS n
        FROM (SELECT s.*, streak, accepted, list_transform(list_filter(accepted, lambda x: x.b = s.bucket), lambda x: x.r)[-64:] AS xs FROM fold f JOIN steps s ON s.source = f.source AND s.i = f.i + 1)))))))"""


def catalog(ev: DataFrame) -> DataFrame:
    """table, plan, provisioned of each source, by its name's last digits."""
    n = F.substring("source", -2, 2).cast("int")
    return ev.select("source").distinct().select(F.col("source").alias("table"), F.when(n == 7, "Basic").otherwise("Analytics").alias("plan"), (n != 9).alias("provisioned"))


CATALOG = """catalog AS (SELECT source AS "table", CASE WHEN right(source, 2)::INT = 7 THEN 'Basic' ELSE 'Analytics' END AS plan, right(source, 2)::INT <> 9 AS provisioned FROM (SELECT DISTINCT source FROM ev))"""


def rule_deps(r: DataFrame) -> DataFrame:
    """rule_id, input, ordinal, required: two named inputs of each rule."""
    et = lambda d: F.element_at(F.array(*[F.lit(t) for t in TYPES]), ((F.col("k") + d) % 5 + 1).cast("int"))
    name = lambda d: F.concat(F.lit("logs-"), et(d), F.lit("-"), F.lpad(((F.col("k") + d * 3) % 12).cast("string"), 2, "0"))
    both = F.array(F.struct(name(0).alias("input"), F.lit(0).alias("ordinal"), F.lit(True).alias("required")), F.struct(name(1).alias("input"), F.lit(1).alias("ordinal"), (F.col("k") % 2 == 0).alias("required")))
    return r.select("rule_id", F.inline(both))


DEPS = """deps AS (SELECT rule_id, 'logs-' || ['click','error','purchase','signup','view'][((k + d) % 5)::INT + 1] || '-' || lpad(((k + d * 3) % 12)::VARCHAR, 2, '0') AS input, d AS ordinal,
  CASE WHEN d = 0 THEN true ELSE k % 2 = 0 END AS required FROM rules, (SELECT unnest([0, 1]) AS d))"""
