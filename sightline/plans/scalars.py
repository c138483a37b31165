"""Queries on column expressions, over columns made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from . import fixtures as fx
from .fixtures import EV, RULES, with_
from .registry import query

KEY = b"a key of thirty-two bytes or more!"


def orders(spark, d):
    return fx.part(spark, d, "orders")


@query("SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 3600 WHEN 4 THEN 86400 WHEN 5 THEN 604800 WHEN 6 THEN 2592000 WHEN 7 THEN 31536000 ELSE 0 END * (o_orderkey % 50) AS s FROM orders")
def parse_interval(spark, d):
    k = F.col("o_orderkey")
    unit = F.element_at(F.array(*[F.lit(u) for u in "smhHdwMyx"]), (k % 9 + 1).cast("int"))
    return orders(spark, d).select("o_orderkey", X.parse_interval(F.concat((k % 50).cast("string"), unit)).alias("s"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 0 ELSE 60 * (o_orderkey % 50) END AS s FROM orders")
def parse_lookback(spark, d):
    k = F.col("o_orderkey")
    n = (k % 50).cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("now-"), n, F.lit("m"))).when(k % 3 == 1, F.concat(F.lit("now-"), n, F.lit("m/d"))).otherwise(F.concat(F.lit("2024-"), n, F.lit("m")))
    return orders(spark, d).select("o_orderkey", X.parse_lookback(text).alias("s"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 86400.0 * (o_orderkey % 30) WHEN 1 THEN 3600.0 * (o_orderkey % 30) + 90 WHEN 2 THEN 60.0 * (o_orderkey % 30) WHEN 3 THEN 86400.0 * (o_orderkey % 30) + 1.5 END::DOUBLE AS s FROM orders")
def parse_iso_duration(spark, d):
    k = F.col("o_orderkey")
    n = (k % 30).cast("string")
    text = F.when(k % 5 == 0, F.concat(F.lit("P"), n, F.lit("D"))).when(k % 5 == 1, F.concat(F.lit("PT"), n, F.lit("H1M30S"))).when(k % 5 == 2, F.concat(F.lit("pt"), n, F.lit("m"))).when(k % 5 == 3, F.concat(F.lit("P"), n, F.lit("DT1.5S"))).otherwise(F.concat(F.lit("P"), n, F.lit("W")))
    return orders(spark, d).select("o_orderkey", X.parse_iso_duration(text).alias("s"))


@query("SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'low' WHEN '2' THEN 'low' WHEN '3' THEN 'medium' WHEN '4' THEN 'high' ELSE 'critical' END AS a, CASE WHEN o_orderpriority LIKE '%HIGH' THEN 'high' WHEN o_orderpriority LIKE '%MEDIUM' THEN 'medium' WHEN o_orderpriority LIKE '%LOW' THEN 'low' ELSE '' END AS b FROM orders")
def normalize_severity(spark, d):
    p = F.col("o_orderpriority")
    return orders(spark, d).select("o_orderkey", X.normalize_severity(F.concat(F.substring(p, 1, 1), F.lit(".0"))).alias("a"), X.normalize_severity(F.concat(F.lit(" "), F.element_at(F.split(p, "-"), 2))).alias("b"))


@query("SELECT o_orderkey, CASE WHEN bool_or(l_linenumber = 4) THEN 'critical' WHEN bool_or(l_linenumber = 3) THEN 'high' WHEN bool_or(l_linenumber = 2) THEN 'low' ELSE 'medium' END AS severity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def detector_severity(spark, d):
    line = F.element_at(F.array(F.lit("none"), F.lit("1"), F.lit("high"), F.lit("5")), F.least(F.col("l_linenumber"), F.lit(4)))
    word = F.when(F.col("l_linenumber") > 4, "none").otherwise(line)
    rows = fx.part(spark, d, "lineitem").join(orders(spark, d), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.collect_list(word).alias("t"))
    return rows.select("o_orderkey", X.detector_severity("t").alias("severity"))


@query(with_(RULES) + "SELECT rule_id, CASE severity WHEN 'critical' THEN 99 WHEN 'high' THEN 73 WHEN 'medium' THEN 47 ELSE 21 END AS a, CASE WHEN k % 2 = 0 THEN 0 ELSE 99 END AS b FROM rules")
def risk_score(spark, d):
    return fx.rules(spark, d).select("rule_id", X.risk_score("severity").alias("a"), X.risk_score(F.when(F.col("k") % 2 == 0, "odd").otherwise("critical"), 0).alias("b"))


@query(with_(EV) + "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN epoch_us(event_ts) // 1000 END AS ms FROM ev")
def epoch_or_rfc3339(spark, d):
    i = F.col("event_id")
    text = F.when(i % 3 == 0, F.unix_millis("event_ts").cast("string")).when(i % 3 == 1, F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise("soon")
    return fx.events(spark, d).select("event_id", X.epoch_or_rfc3339(text).alias("ms"))


@query(with_(EV) + "SELECT dayofweek(event_ts) || ':' || lpad(hour(event_ts)::VARCHAR, 2, '0') AS bucket, count(*) AS n FROM ev GROUP BY 1")
def volume_bucket(spark, d):
    return fx.events(spark, d).groupBy(X.volume_bucket("event_ts").alias("bucket")).agg(F.count("*").alias("n"))


@query(with_(RULES) + "SELECT rule_id, round(greatest(0.0, least(1.0, (lookback_s - 180)::DOUBLE / interval_s)), 6) AS rate FROM rules")
def catch_rate(spark, d):
    return fx.rules(spark, d).select("rule_id", F.round(X.catch_rate("lookback_s", F.lit(180), "interval_s"), 6).alias("rate"))


@query(with_(EV) + "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'timeout' WHEN 1 THEN 'authorization' WHEN 2 THEN 'authentication' WHEN 3 THEN 'TLS' WHEN 4 THEN 'connection' ELSE 'other' END AS category FROM ev WHERE event_type = 'error'")
def error_category(spark, d):
    words = F.array(*[F.lit(w) for w in ("context deadline exceeded after ", "HTTP 403 Forbidden ", "HTTP 401 ", "x509: bad chain ", "dial tcp: connection refused ", "strange ")])
    text = F.concat(F.element_at(words, (F.col("event_id") % 6 + 1).cast("int")), "props")
    return fx.events(spark, d).where("event_type = 'error'").select("event_id", X.error_category(text).alias("category"))


@query(with_(EV) + "SELECT event_id, 'a ' || event_type || ' b' AS message FROM ev")
def clean_message(spark, d):
    text = F.concat(F.lit("\x1b[31m a\t "), "event_type", F.lit("\x1b[0m​\n b \x07"))
    return fx.events(spark, d).select("event_id", X.clean_message(text).alias("message"))


@query(with_(RULES) + "SELECT rule_id, name AS tail, CASE WHEN k % 2 = 0 THEN 'installed 1.' || k || '; current' ELSE 'installed 1.' || k || '; current 2.0' END AS version FROM rules")
def resource_tail(spark, d):
    v = F.concat(F.lit("1."), F.col("k").cast("string"))
    return fx.rules(spark, d).select("rule_id", X.resource_tail(F.concat(F.lit("/a/b/"), "name", F.lit("/"))).alias("tail"), X.version_detail(v, F.when(F.col("k") % 2 == 0, v).otherwise(F.lit("2.0"))).alias("version"))


@query(with_(RULES) + "SELECT rule_id, 'a,' || severity AS su, CASE WHEN k % 2 = 0 THEN name ELSE severity END AS first, '\"' || severity || '\", \"x\"' AS quoted FROM rules WHERE severity <> 'zz'")
def array_helpers(spark, d):
    s = F.col("severity")
    return fx.rules(spark, d).select("rule_id", F.array_join(X.sorted_unique(F.array(s, F.lit("a"), s)), ",").alias("su"), X.first_non_empty(F.when(F.col("k") % 2 == 0, F.col("name")).otherwise(F.lit("")), s).alias("first"), X.quoted_join(F.array(s, F.lit("x"))).alias("quoted"))


@query(with_(EV) + "SELECT DISTINCT source, 'src-' || left(sha256(from_hex(repeat('5c', 0) || $O$) || from_hex(sha256(from_hex($I$) || encode('src') || '\\x00'::BLOB || encode(source)))), 12) AS hidden FROM ev".replace("from_hex(repeat('5c', 0) || $O$)", "from_hex('" + bytes(b ^ 0x5C for b in KEY.ljust(64, b"\0")).hex() + "')").replace("from_hex($I$)", "from_hex('" + bytes(b ^ 0x36 for b in KEY.ljust(64, b"\0")).hex() + "')"))
def redact(spark, d):
    s = fx.events(spark, d).select("source", F.col("source").alias("hidden")).distinct()
    once = X.redact(s, {"hidden": "src"}, KEY)
    return X.redact(once, {"hidden": "src"}, KEY)  # pseudonyms stay as they are


@query(with_(RULES) + "SELECT rule_id, 'finding-' || left(sha256(array_to_string(['t', 'i', 'b', 'dead-detection', rule_id, 'starved', '', ''], chr(0))), 20) AS finding_id FROM rules")
def finding_id(spark, d):
    lit = F.lit
    return fx.rules(spark, d).select("rule_id", X.finding_id(lit("t"), lit("i"), lit("b"), lit("dead-detection"), "rule_id", lit("starved"), lit(""), lit("")).alias("finding_id"))


@query(with_(RULES) + """SELECT rule_id, CASE k % 4 WHEN 0 THEN 'all matching sources stale or empty' WHEN 1 THEN 'required fields are missing' WHEN 2 THEN 'source has no events' ELSE 'some new reason' END AS label,
  CASE k % 4 WHEN 0 THEN 'detection can''t fire' WHEN 1 THEN 'reduced visibility' WHEN 2 THEN 'source degraded' ELSE 'new class' END AS class FROM rules""")
def labels(spark, d):
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.col("k") % 4 + 1).cast("int"))
    kind, reason = pick("dead-detection", "impaired-detection", "source-degraded", "new-class"), pick("starved", "missing-fields", "empty", "some-new-reason")
    return fx.rules(spark, d).select("rule_id", X.reason_label(kind, reason).alias("label"), X.class_label(kind).alias("class"))


@query(with_(RULES) + "SELECT rule_id, 'scope-' || left(sha256(array_to_string(list_concat(['installed', name, 'schema=1', 'stateful=0'], list_transform(list_sort(patterns), lambda p: 'include=' || p), ['candidate=' || rule_id]), chr(0))), 20) AS scope_id FROM rules")
def scope_id(spark, d):
    none = F.array().cast("array<string>")
    return fx.rules(spark, d).select("rule_id", X.scope_id(F.lit("installed"), "name", F.lit(True), F.lit(False), F.reverse("patterns"), none, F.array("rule_id")).alias("scope_id"))


@query(with_(RULES) + "SELECT rule_id, 'target-' || left(sha256('b' || chr(0) || 'https://host-' || k || '.example/A' || chr(0) || rule_id), 20) AS target_id FROM rules")
def target_id(spark, d):
    url = F.concat(F.lit(" HTTPS://user:pw@Host-"), F.col("k").cast("string"), F.when(F.col("k") % 2 == 0, ".EXAMPLE/A/?q=1#f").otherwise(".example/A//"))
    return fx.rules(spark, d).select("rule_id", X.target_id(F.lit(" B "), url, "rule_id").alias("target_id"))


@query(with_(RULES) + "SELECT rule_id, 'config-' || left(sha256('max-stale=' || lookback_s || chr(10) || 'policy=' || CASE WHEN k % 2 = 0 THEN name ELSE 'none' END || chr(10)), 20) AS configuration_id FROM rules")
def configuration_id(spark, d):
    return fx.rules(spark, d).select("rule_id", X.configuration_id({"max-stale": F.col("lookback_s"), "policy": F.when(F.col("k") % 2 == 0, F.col("name"))}).alias("configuration_id"))


@query(with_(RULES) + "SELECT rule_id, CASE WHEN k % 2 = 0 THEN 'installed 1.' || k || '; current' ELSE 'installed 1.' || k || '; current 2.0' END AS detail FROM rules")
def version_detail(spark, d):
    v = F.concat(F.lit("1."), F.col("k").cast("string"))
    return fx.rules(spark, d).select("rule_id", X.version_detail(v, F.when(F.col("k") % 2 == 0, v).otherwise(F.lit("2.0"))).alias("detail"))
