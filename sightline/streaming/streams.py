"""The same questions on streams: event-time windows with watermarks, sessions, and state per source.

Streams hold source, event_id, event_ts, ingest_ts and value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import volume_bucket
from ..operators.history import VERDICT
from .stateful import DRIFT, Baseline, Drift, Silence, by_source

#: Tasks that the rules of one source and schedule are dealt over.
DEALT = 8


def last_event(stream: DataFrame) -> DataFrame:
    """source, last_event, docs so far (update or complete mode)."""
    return stream.groupBy("source").agg(F.max("event_ts").alias("last_event"), F.count("*").alias("docs"))


def hourly_volume(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """source, hour, n of hours that the watermark has passed."""
    hours = stream.withWatermark("event_ts", delay).groupBy("source", F.window("event_ts", "1 hour")).agg(F.count("*").alias("n"))
    return hours.select("source", F.col("window.start").alias("hour"), "n")


def sliding_volume(stream: DataFrame, size: str = "1 hour", slide: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    windows = stream.withWatermark("event_ts", delay).groupBy("source", F.window("event_ts", size, slide)).agg(F.count("*").alias("n"))
    return windows.select("source", F.col("window.start").alias("start"), "n")


def activity_sessions(stream: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """source, first, last_plus_gap, n: runs of events without a pause of ``gap``; between them a source was silent."""
    sessions = stream.withWatermark("event_ts", delay).groupBy("source", F.session_window("event_ts", gap)).agg(F.count("*").alias("n"))
    return sessions.select("source", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last_plus_gap"), "n")


def late_by_margins(stream: DataFrame, schedules: DataFrame, delay: str = "1 hour") -> DataFrame:
    """source, margins, hour, late: events of hours that the watermark has passed, once for each margin that their lag is beyond.

    schedules (static): source, schedules: the different arrays of margins in seconds, of one each for most
    rules. An event meets the schedules of its source and is counted before any rule is met.
    """
    lag = F.greatest(F.lit(0), F.floor((F.unix_micros("ingest_ts") - F.unix_micros("event_ts")) / 1_000_000))
    known = schedules.select(F.col("source").alias("read"), "schedules")
    # A null source meets nothing but moves the watermark, which a filter on it would pass by.
    met = stream.withWatermark("event_ts", delay).join(known, F.col("source").eqNullSafe(F.col("read")))
    each = met.select("source", "event_ts", lag.alias("lag_s"), F.explode("schedules").alias("margins"))
    lost = each.withColumn("n", F.size(F.filter("margins", lambda m: F.col("lag_s") > m))).where("n > 0")
    hours = lost.groupBy("source", "margins", F.window("event_ts", "1 hour")).agg(F.sum("n").alias("late"))
    return hours.select("source", "margins", F.col("window.start").alias("hour"), "late")


def late_of_rules(late: DataFrame, edges: DataFrame) -> DataFrame:
    """rule_id, source, hour, late of a table of ``late_by_margins``. edges: rule_id, source, margins, a row for each rule and source.

    Rules meet the hours of a month as one row; the rows of a key are dealt over DEALT tasks, since each gives as many as there are hours.
    """
    hours = late.groupBy("source", "margins", F.date_trunc("month", "hour")).agg(F.collect_list(F.struct("hour", "late")).alias("hours"))
    dealt = hours.select("source", "margins", "hours", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("part"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["source", "margins", "part"]
    rules = edges.withColumn("part", F.pmod(F.xxhash64("rule_id"), F.lit(DEALT)).cast("int")).repartition(parts, *key)
    return rules.hint("merge").join(dealt, key).select("rule_id", "source", F.inline("hours"))


def volume_state(counters: DataFrame, **options) -> DataFrame:
    """Verdicts of the adaptive baseline on a stream of source, scan_ts, docs, in_downtime; typed state per source.

    A batch's scans of a source are taken in order of time; options are those of ``stateful.Baseline``.
    """
    ready = counters.select("source", "scan_ts", volume_bucket("scan_ts").alias("bucket"), F.col("docs").cast("double").alias("docs"), "in_downtime")
    return by_source(ready, Baseline(**options), VERDICT, "ProcessingTime" if options.get("expire_s") else "None")


def volume_of_events(stream: DataFrame, in_downtime: Column, delay: str = "1 hour", **options) -> DataFrame:
    """The same on events: each hour that the watermark has passed is a scan at its end. in_downtime: of scan_ts."""
    hours = hourly_volume(stream, delay)
    scans = hours.select("source", (F.col("hour") + F.expr("interval 1 hour")).alias("scan_ts"), F.col("n").alias("docs")).withColumn("in_downtime", in_downtime)
    return volume_state(scans, deltas=True, **options)


def silence_by_clock(stream: DataFrame, max_stale_s: float) -> DataFrame:
    """source, last_event, told_at of sources that have sent nothing for max_stale_s seconds by the clock, though nothing else comes either."""
    return by_source(stream.select("source", "event_ts"), Silence(max_stale_s), "source string, last_event timestamp, told_at timestamp", "ProcessingTime")


def drift_of_events(stream: DataFrame, fields: list[tuple[str, str, Column]], delay: str = "1 hour") -> DataFrame:
    """source, day, status, added, removed, type_changed of each day that the watermark has passed. fields: name, type, condition.

    A field and type of a day goes on once while it is fresh, so the state's worker sees few of the events.
    """
    named = F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("field"), F.lit(t).alias("type"))) for n, t, c in fields])))
    each = stream.withWatermark("event_ts", delay).select("source", "event_ts", F.to_date("event_ts").alias("day"), named.alias("f")).select("source", "event_ts", "day", "f.*")
    once = each.dropDuplicatesWithinWatermark(["source", "day", "field", "type"])
    return by_source(once.select("source", "event_ts", "field", "type"), Drift(), DRIFT, "EventTime")


def reconciliation(events: DataFrame, rollup: DataFrame, keys: list[str], minutes: int, delay: str = "1 hour") -> DataFrame:
    """bin, keys, raw_n, rollup_n, match: counts of each bin of the event stream against those that another stream stored.

    rollup: bin (its start), keys, rollup_n. A bin that either stream lacks is told once both watermarks
    have passed its end.
    """
    size = f"{minutes} minutes"
    raw = events.withWatermark("event_ts", delay).groupBy(F.window("event_ts", size), *keys).agg(F.count("*").alias("raw_n"))
    stored = rollup.withWatermark("bin", delay).select(F.window("bin", size), *keys, "rollup_n")
    both = raw.join(stored, ["window", *keys], "full_outer")
    return both.select(F.col("window.start").alias("bin"), *keys, "raw_n", "rollup_n", F.col("raw_n").eqNullSafe(F.col("rollup_n")).alias("match"))


def silent_sources(stream: DataFrame, max_stale_s: int, delay: str = "1 hour") -> DataFrame:
    """source, last_event, silent_at when event time has moved max_stale_s beyond a source's last event; again after each silence."""
    import pandas as pd

    def step(key, pdfs, state):
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"source": [key[0]], "last_event": pd.to_datetime([last], unit="us"), "silent_at": pd.to_datetime([last + max_stale_s * 1_000_000], unit="us")})
            return
        last = state.get[0] if state.exists else 0
        for pdf in pdfs:
            last = max(last, int(pdf["event_ts"].astype("datetime64[us]").astype("int64").max()))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + max_stale_s * 1000, state.getCurrentWatermarkMs() + 1))

    rows = stream.select("source", "event_ts").withWatermark("event_ts", delay)
    return rows.groupBy("source").applyInPandasWithState(step, "source string, last_event timestamp, silent_at timestamp", "last long", "append", "EventTimeTimeout")


def schema_drift(stream: DataFrame) -> DataFrame:
    """source, day, added, removed, type_changed against the source's snapshot before. stream: source, day, fields (field=type, joined by commas).

    The whole snapshot of a day arrives as one row.
    """
    import json

    import pandas as pd

    def step(key, pdfs, state):
        before = json.loads(state.get[0]) if state.exists else None
        rows = []
        for _, r in pd.concat(list(pdfs)).sort_values("day").iterrows():
            now = dict(x.split("=", 1) for x in r["fields"].split(",") if x)
            if before:
                rows.append((key[0], r["day"], ",".join(sorted(now.keys() - before.keys())), ",".join(sorted(before.keys() - now.keys())), ",".join(sorted(f for f in now.keys() & before.keys() if now[f] != before[f]))))
            before = now
        state.update((json.dumps(before),))
        yield pd.DataFrame(rows, columns=["source", "day", "added", "removed", "type_changed"])

    return stream.groupBy("source").applyInPandasWithState(step, "source string, day string, added string, removed string, type_changed string", "state string", "append", "NoTimeout")


def scan_query(stream: DataFrame, scan: Callable[[DataFrame], dict[str, DataFrame]], path: str, checkpoint: str, interval: str | None = None):
    """Evaluate ``scan`` on each batch and write its tables, then mark the batch as done.

    A batch that is delivered again replaces its own tables. If a scan fails, the snapshots before stay,
    ``up`` of that batch is 0, and the query goes on.
    """

    def deliver(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        ok, error = 1, ""
        try:
            for name, df in scan(batch).items():
                df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        except Exception as e:  # the failure is data here: it must not end the watch
            ok, error = 0, str(e)[:500]
        batch.sparkSession.createDataFrame([(batch_id, ok, error)], "batch long, up int, error string").coalesce(1).write.mode("overwrite").parquet(f"{path}/up/batch={batch_id}")
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
