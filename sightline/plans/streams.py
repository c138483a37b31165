"""Streaming queries: the events as a stream, drained to a table."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings, profile, resolve, verdicts
from ..sources.shared import shared_dir, written
from ..streaming import streams
from ..streaming.memory import Memory, remembering_scan
from . import coverage as cv
from . import fixtures as fx
from .fixtures import EDGES, EV, PAT, RULES, SRC, with_
from .registry import SQL, query

us = F.unix_micros
#: What the watermark has passed once all events are read: an hour before the last one.
PASSED = "(SELECT max(event_ts) - INTERVAL 1 HOUR FROM ev)"


def stream_of(spark: SparkSession, d: str, files: int | None = None) -> DataFrame:
    """The events as a stream; files: of a batch, at most."""
    path = f"{d}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    # The glob is held against the names of files: those in a folder of part files have others.
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    raw = reader.parquet(path) if folder else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    source = F.concat(F.lit("logs-"), "event_type", F.lit("-"), F.lpad((F.col("user_id") % 10).cast("string"), 2, "0"))
    late = F.expr("cast(ts as timestamp) + make_dt_interval(0, 0, 0, (event_id * 37) % (60 * (1 + (user_id % 10) * 3)))")
    return raw.select(source.alias("source"), "event_id", "user_id", "value", (F.octet_length("props") + 40).cast("long").alias("size_bytes"), F.col("ts").cast("timestamp").alias("event_ts"), late.alias("ingest_ts"))


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """All that the stream gives by now, as a table."""
    spark = df.sparkSession
    out, at = shared_dir(spark, "stream"), shared_dir(spark, "stream-state")
    if mode == "append":
        q = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
    else:
        q = df.writeStream.outputMode(mode).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query(with_(EV) + "SELECT source, epoch_us(max(event_ts)) AS last_us, count(*) AS docs FROM ev GROUP BY source")
def stream_last_event(spark, d):
    return drained(streams.last_event(stream_of(spark, d)), "complete").select("source", us("last_event").alias("last_us"), "docs")


@query(with_(EV) + f"SELECT source, epoch_us(hour) AS hour, n FROM (SELECT source, date_trunc('hour', event_ts) AS hour, count(*) AS n FROM ev GROUP BY ALL) WHERE hour + INTERVAL 1 HOUR <= {PASSED}")
def stream_hourly_volume(spark, d):
    return drained(streams.hourly_volume(stream_of(spark, d))).withColumn("hour", us("hour"))


@query(with_(EV, "w AS (SELECT source, time_bucket(INTERVAL 15 MINUTE, event_ts) - to_minutes(15 * i) AS start FROM ev, (SELECT unnest([0, 1, 2, 3]) AS i))") + f"SELECT source, epoch_us(start) AS start, count(*) AS n FROM w WHERE start + INTERVAL 1 HOUR <= {PASSED} GROUP BY ALL")
def stream_sliding_volume(spark, d):
    return drained(streams.sliding_volume(stream_of(spark, d))).withColumn("start", us("start"))


@query(with_(EV, """g AS (SELECT source, event_ts, sum(b) OVER (PARTITION BY source ORDER BY event_ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN event_ts - lag(event_ts) OVER (PARTITION BY source ORDER BY event_ts, event_id) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS b FROM ev))""")
  + f"SELECT source, epoch_us(min(event_ts)) AS first, epoch_us(max(event_ts) + INTERVAL 3 HOUR) AS last_plus_gap, count(*) AS n FROM g GROUP BY source, s HAVING max(event_ts) + INTERVAL 3 HOUR <= {PASSED}")
def stream_activity_sessions(spark, d):
    out = drained(streams.activity_sessions(stream_of(spark, d), "3 hours"))
    return out.withColumns({"first": us("first"), "last_plus_gap": us("last_plus_gap")})


@query(with_(EV, RULES, PAT, EDGES) + f"""SELECT rule_id, source, epoch_us(hour) AS hour, sum(1)::BIGINT AS late FROM (SELECT source, date_trunc('hour', event_ts) AS hour, greatest(0, (epoch_us(ingest_ts) - epoch_us(event_ts)) // 1000000) AS lag FROM ev) e JOIN edges USING (source) JOIN rules USING (rule_id)
  WHERE lag > lookback_s - interval_s AND hour + INTERVAL 1 HOUR <= {PASSED} GROUP BY ALL""")
def stream_late_events(spark, d):
    return late_of(spark, d, fx.rules(spark, d))


@query(SQL["stream_late_events"])
def stream_late_events_all(spark, d):
    """Of every rule, as stream_late_events is by now."""
    return late_of(spark, d, fx.rules(spark, d))


def late_of(spark, d, r):
    """Events are counted in the stream by the schedules of their source; rules meet the counts in the table that is returned."""
    margins = r.groupBy("rule_id").agg(F.sort_array(F.collect_list(F.col("lookback_s") - F.col("interval_s"))).alias("margins"))
    edges = written(resolve.pattern_edges(r, cv.sources_of(spark, d)).join(margins.hint("merge"), "rule_id"), "margins")
    schedules = written(edges.groupBy("source").agg(F.collect_set("margins").alias("schedules")), "schedules")
    late = drained(streams.late_by_margins(stream_of(spark, d), schedules))
    return streams.late_of_rules(late, edges).withColumn("hour", us("hour"))


def replayed(df: DataFrame) -> DataFrame:
    """A table as a stream."""
    path = shared_dir(df.sparkSession, "replay")
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


@query(SQL["volume_baseline"])
def stream_volume_state(spark, d):
    """The adaptive baseline on a stream; its rows equal those of volume_baseline."""
    out = drained(streams.volume_state(replayed(fx.counters(fx.events(spark, d)))))
    return out.select("source", us("scan_ts").alias("scan_ts"), "status", F.round("rate", 6).alias("rate"), F.round("z", 6).alias("z"), "samples")


@query(SQL["volume_baseline"] + f" WHERE scan_ts <= {PASSED}")
def stream_volume_of_events(spark, d):
    """The adaptive baseline on hourly counts of the event stream itself."""
    out = drained(streams.volume_of_events(stream_of(spark, d), F.hour("scan_ts") == 3))
    return out.select("source", us("scan_ts").alias("scan_ts"), "status", F.round("rate", 6).alias("rate"), F.round("z", 6).alias("z"), "samples")


@query(with_(EV) + "SELECT source, epoch_us(max(event_ts)) AS last_us FROM ev GROUP BY source")
def stream_silence_by_clock(spark, d):
    """Every source falls silent when the stream stops, and is told by the clock alone."""
    out, at = shared_dir(spark, "silence"), shared_dir(spark, "silence-state")
    df = streams.silence_by_clock(stream_of(spark, d), 2)
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(processingTime="1 second").start()
    told = spark.read.schema(df.schema).parquet(out)
    asked = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.col("user_id") % 10).distinct().count()
    for _ in range(120):
        q.exception()
        if q.lastProgress and told_count(spark, out, df.schema) >= asked:
            break
        q.awaitTermination(1)
    q.stop()
    told = spark.read.schema(df.schema).parquet(out)
    return told.groupBy("source").agg(F.max("last_event").alias("l")).select("source", us("l").alias("last_us"))


def told_count(spark, path, schema):
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_spark_metadata")
    return spark.read.schema(schema).parquet(path).select("source").distinct().count() if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else 0


@query(with_(EV, fx.FIELD_DAYS, """snap AS (SELECT source, day, list_sort(list(DISTINCT field || '=' || type)) AS f, list_sort(list(DISTINCT field)) AS n FROM field_days GROUP BY source, day), p AS (SELECT *, lag(n) OVER w AS pn, lag(f) OVER w AS pf FROM snap WINDOW w AS (PARTITION BY source ORDER BY day))""")
  + f"""SELECT source, epoch_us(day::TIMESTAMP) AS day, CASE WHEN pn IS NULL THEN 'warming' WHEN f <> pf THEN 'drift' ELSE 'ok' END AS status, CASE WHEN pn IS NULL THEN '' ELSE array_to_string(list_filter(n, lambda x: NOT list_contains(pn, x)), ',') END AS added,
  CASE WHEN pn IS NULL THEN '' ELSE array_to_string(list_filter(pn, lambda x: NOT list_contains(n, x)), ',') END AS removed,
  CASE WHEN pn IS NULL THEN '' ELSE array_to_string(list_filter(n, lambda x: list_contains(pn, x) AND list_filter(f, lambda y: starts_with(y, x || '=')) <> list_filter(pf, lambda y: starts_with(y, x || '='))), ',') END AS type_changed FROM p WHERE day + INTERVAL 1 DAY <= {PASSED}""")
def stream_drift_of_events(spark, d):
    """Schema drift by day from the fields of the events themselves."""
    return drained(streams.drift_of_events(stream_of(spark, d), fx.field_types())).withColumn("day", us("day"))


@query(with_(EV, """raw AS (SELECT time_bucket(INTERVAL 20 MINUTE, event_ts) AS b, source, count(*) AS raw_n, count(*) FILTER (event_id % 97 <> 0) AS n FROM ev GROUP BY ALL),
  stored AS (SELECT b, CASE WHEN source = 'logs-view-03' THEN 'ghost' ELSE source END AS source, n AS rollup_n FROM raw WHERE n > 0 AND (epoch_us(b) // 1200000000) % 5 <> 0), mark AS (SELECT least((SELECT max(event_ts) FROM ev), (SELECT max(b) FROM stored)) - INTERVAL 1 HOUR AS m)""")
  + """SELECT epoch_us(coalesce(r.b, s.b)) AS bin, coalesce(r.source, s.source) AS source, raw_n, rollup_n, raw_n IS NOT DISTINCT FROM rollup_n AS match FROM raw r FULL OUTER JOIN stored s ON r.b = s.b AND r.source = s.source, mark WHERE coalesce(r.b, s.b) + INTERVAL 20 MINUTE <= m""")
def stream_bin_reconciliation(spark, d):
    """The event stream against a stream of stored counts that lost every 97th event and whole bins, and has bins of a source that sends nothing."""
    ev = fx.events(spark, d)
    bins = ev.where("event_id % 97 <> 0").groupBy(F.window("event_ts", "20 minutes").start.alias("bin"), "source").agg(F.count("*").alias("rollup_n"))
    kept = bins.where(F.floor(F.unix_seconds("bin") / 1200) % 5 != 0).withColumn("source", F.when(F.col("source") == "logs-view-03", "ghost").otherwise(F.col("source")))
    return drained(streams.reconciliation(stream_of(spark, d), replayed(kept), ["source"], 20)).withColumn("bin", us("bin"))


@query(with_(EV) + f"SELECT source, epoch_us(max(event_ts)) AS last_us, epoch_us(max(event_ts)) + 10800000000 AS silent_us FROM ev GROUP BY source HAVING max(event_ts) + INTERVAL 3 HOUR < date_trunc('millisecond', {PASSED})")
def stream_silent_sources(spark, d):
    out = drained(streams.silent_sources(stream_of(spark, d), 3 * 3600))
    return out.select("source", us("last_event").alias("last_us"), us("silent_at").alias("silent_us"))


@query(with_(EV, fx.FIELD_DAYS, """s AS (SELECT source, day, list_sort(list(DISTINCT field)) AS n, list(DISTINCT field || '=' || type) AS f FROM field_days GROUP BY ALL), p AS (SELECT *, lag(n) OVER w AS pn, lag(f) OVER w AS pf FROM s WINDOW w AS (PARTITION BY source ORDER BY day))""")
  + """SELECT source, day::VARCHAR AS day, array_to_string(list_filter(n, lambda x: NOT list_contains(pn, x)), ',') AS added, array_to_string(list_filter(pn, lambda x: NOT list_contains(n, x)), ',') AS removed,
  array_to_string(list_filter(n, lambda x: list_contains(pn, x) AND len(list_filter(f, lambda y: starts_with(y, x || '=') AND NOT list_contains(pf, y))) > 0), ',') AS type_changed FROM p WHERE pn IS NOT NULL""")
def stream_schema_drift(spark, d):
    days = fx.field_days(fx.events(spark, d))
    snaps = days.groupBy("source", F.col("day").cast("string").alias("day")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "field", "type"))), ",").alias("fields"))
    return drained(streams.schema_drift(replayed(snaps)))


def judge_of(rules):
    """Findings of dead rules, degraded and unused sources by all that was seen so far, and which earlier ones are gone for sure."""

    def judge(whole, before, now):
        s = written(profile.inventory(whole), "sources")
        e, h, res = written(resolve.pattern_edges(rules, s), "edges"), verdicts.source_health(s, now, float(fx.MAX_STALE_S)), written(cv.resolutions_from(rules, s), "resolutions")
        v = written(verdicts.rule_verdicts(rules, e, h), "verdicts")
        none = rules.sparkSession.createDataFrame([], "rule_id string, source string, reason string, dependency string, selector string, expression string")
        found = findings.build_findings(v, h, verdicts.unused_telemetry(s, e, rules), none, none, rules, "t").withColumn("scope_id", F.lit("scan"))
        used = h.join(resolve.blast_radius(e, rules).select("source", "consumers"), "source", "left")
        lag = profile.ingest_lag(whole, s, now - timedelta(days=1))
        rows = verdicts.required_fields(e, rules, s.select("source", F.lit("unavailable").alias("status"), F.array().cast("array<string>").alias("fields")))
        gone = findings.recovery_confirmed(before.where("active"), verdicts.rule_flags(res, s), v, used, lag, rows, {"source_resolution": "assessed"}, rules, res, "complete").where("confirmed")
        return {"sources": s, "verdicts": v.select("rule_id", "section", "reason"), "findings": found, "recovered": gone.select("scope_id", "finding_id")}

    return judge


#: For scans of sources alone.
NO_RULES = "rule_id string, name string, enabled boolean, severity string, interval_s long, lookback_s long, patterns array<string>, timestamp_override string, required_fields array<string>, backend_object_id string"


def scanned(spark, d, rules, files=None):
    """The memory of a scan over the whole stream; files: of a batch, at most."""
    memory = Memory(spark, shared_dir(spark, "scan"), [])
    stream = stream_of(spark, d, files).select("source", "event_id", "event_ts", "ingest_ts", "size_bytes")
    remembering_scan(stream, memory, judge_of(rules), shared_dir(spark, "scan-state")).awaitTermination()
    return memory


@query(with_(EV) + "SELECT source, count(*) AS docs FROM ev GROUP BY source")
def stream_scan(spark, d):
    """A scan of every batch, of sources alone, that remembers those before it; the documents that its last report counts."""
    return scanned(spark, d, spark.createDataFrame([], NO_RULES)).report("sources", "source string, docs long")


#: Health when the last event came.
AT_LAST = SRC.replace(f"TIMESTAMP '{fx.NOW}'", "(SELECT max(event_ts) FROM ev)")


@query(with_(EV, RULES, PAT, EDGES, AT_LAST, cv.STARVED, cv.LEGACY) + """SELECT 'dead-detection' AS class, reason, rule_id, '' AS source FROM legacy WHERE section = 'dead' UNION ALL SELECT 'source-degraded', status, '', source FROM health WHERE status <> 'ok'
  UNION ALL SELECT 'unused-telemetry', 'unused', '', source FROM src WHERE source NOT IN (SELECT source FROM edges JOIN rules USING (rule_id) WHERE enabled)""")
def stream_scan_findings(spark, d):
    """Findings that are active after the last scan of the stream."""
    memory = scanned(spark, d, fx.rules(spark, d))
    return memory.findings(memory.last_commit()).where("active").select("class", "reason", "rule_id", "source")
