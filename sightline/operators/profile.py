"""One pass over the events: a mergeable profile, from which each source's evidence is read.

A profile has two kinds of rows, made by grouping sets from a single scan and combined before they
move: ``hour`` rows (documents, bytes, last events and the fields seen in an hour of a source) and
``lag`` rows (how many events of the window before ``now`` arrived in an hour with a lag of so many
milliseconds). Without ``now`` all events count, and the readers' ``since`` says where a window begins.
Profiles of parts of the events, or of tenants, are united by adding their rows; every reader below
aggregates what it needs, so none scans the events again. Fields are bits of as many longs as they need.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evidence import WINDOW_S, freshness_of, lag_of_counts

MEASURES = ["lag_ms", "docs", "size_bytes", "last_event", "by_event", "by_ingest", "seen"]
#: Fields in one long.
BITS = 62


def source_profile(events: DataFrame, now: datetime | None, fields: list[tuple[str, str, Column]] = (), keys: tuple[str, ...] = ("source",), window_s: int = WINDOW_S) -> DataFrame:
    """keys, part (hour, lag), hour, lag_ms, docs, size_bytes, last_event, by_event, by_ingest, seen (array of longs).

    events: keys, event_ts, ingest_ts, size_bytes. fields: name, type and the condition on which an event
    has it. by_event and by_ingest: the last ones inside the window. Times that are null have a null hour.
    """
    within = lambda c: F.lit(True) if now is None else F.col(c).between(F.lit(now - timedelta(seconds=window_s)), F.lit(now))
    inside = lambda c: F.when(within(c), F.col(c))
    lag = F.greatest(F.lit(0), F.floor((F.unix_micros("ingest_ts") - F.unix_micros("event_ts")) / 1000))
    paired = F.col("event_ts").isNotNull() & F.col("ingest_ts").isNotNull() & within("ingest_ts")
    bit = lambda i: F.when(F.coalesce(fields[i][2], F.lit(False)), F.lit(1 << i % BITS)).otherwise(0).cast("long")
    words = [sum((bit(i) for i in range(at, min(at + BITS, len(fields)))), F.lit(0).cast("long")).alias(f"w{at}") for at in range(0, len(fields), BITS)]
    rows = events.select(*keys, F.date_trunc("hour", "event_ts").alias("hour"), F.when(paired, F.date_trunc("hour", "ingest_ts")).alias("arrived"), F.when(paired, lag).alias("lag_ms"), "size_bytes", "event_ts", inside("event_ts").alias("e"), inside("ingest_ts").alias("i"), *words)
    sets = rows.groupingSets([[*keys, "hour"], [*keys, "arrived", "lag_ms"]], *keys, "hour", "arrived", "lag_ms")
    seen = F.array(*[F.bit_or(f"w{at}") for at in range(0, len(fields), BITS)]) if fields else F.array().cast("array<bigint>")
    out = sets.agg(
        F.when(F.grouping("lag_ms") == 1, "hour").otherwise("lag").alias("part"), F.count("*").alias("docs"), F.sum("size_bytes").alias("size_bytes"), F.max("event_ts").alias("last_event"), F.max("e").alias("by_event"),
        F.max("i").alias("by_ingest"), seen.alias("seen"))
    return out.where("part = 'hour' or lag_ms is not null").select(*keys, "part", F.coalesce("hour", "arrived").alias("hour"), *MEASURES)


def merged(profile: DataFrame, keys: tuple[str, ...] = ("source",), n_fields: int = 0) -> DataFrame:
    """The rows of several profiles, added up to one profile."""
    words = F.array(*[F.bit_or(F.coalesce(F.col("seen")[i], F.lit(0).cast("long"))) for i in range(-(-n_fields // BITS))]) if n_fields else F.array().cast("array<bigint>")
    out = profile.groupBy(*keys, "part", "hour", "lag_ms").agg(F.sum("docs").alias("docs"), F.sum("size_bytes").alias("size_bytes"), *[F.max(c).alias(c) for c in ("last_event", "by_event", "by_ingest")], words.alias("seen"))
    return out.select(*keys, "part", "hour", *MEASURES)


def inventory(profile: DataFrame, *keys: str) -> DataFrame:
    """keys (source), docs, size_bytes, last_event, as ``evidence.source_inventory``."""
    own = profile.where((F.col("part") == "hour") & ~F.col("source").startswith("."))
    return own.groupBy(*(keys or ("source",))).agg(F.sum("docs").alias("docs"), F.sum("size_bytes").alias("size_bytes"), F.max("last_event").alias("last_event"))


def bounded_freshness(profile: DataFrame, requests: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """As ``evidence.bounded_freshness`` at the profile's time and window."""
    found = profile.where("part = 'hour'").groupBy("source").agg(F.max("by_event").alias("by_event"), F.max("by_ingest").alias("by_ingest"))
    return freshness_of(found, requests, window_s)


def ingest_lag(profile: DataFrame, sources: DataFrame, since: datetime | None = None) -> DataFrame:
    """As ``evidence.ingest_lag(exact=True)``: of all events of the window, by running sums over the lags that occur.

    since: the first hour of arrival that counts.
    """
    lags = profile.where("part = 'lag'")
    counts = (lags if since is None else lags.where(F.col("hour") >= F.lit(since))).groupBy("source", "lag_ms").agg(F.sum("docs").alias("n"))
    return lag_of_counts(counts, sources)


def hourly_volume(profile: DataFrame) -> DataFrame:
    """source, hour, n."""
    return profile.where("part = 'hour' and hour is not null").groupBy("source", "hour").agg(F.sum("docs").alias("n"))


def counters(profile: DataFrame) -> DataFrame:
    """source, scan_ts, docs: documents so far at the end of each hour with events."""
    total = F.sum("n").over(Window.partitionBy("source").orderBy("hour"))
    return hourly_volume(profile).select("source", (F.col("hour") + F.expr("interval 1 hour")).alias("scan_ts"), total.alias("docs"))


def fields_seen(profile: DataFrame, fields: list[tuple[str, str, Column]], by: Column) -> DataFrame:
    """source, by, field, type of all fields that events had; ``by``: of the hour, such as its day."""
    words = profile.where("part = 'hour'").groupBy("source", by.alias("by")).agg(*[F.bit_or(F.col("seen")[at]).alias(f"w{at}") for at in range(-(-len(fields) // BITS))])
    has = lambda i: F.col(f"w{i // BITS}").bitwiseAND(F.lit(1 << i % BITS)) != 0
    named = F.array(*[F.when(has(i), F.struct(F.lit(name).alias("field"), F.lit(kind).alias("type"))) for i, (name, kind, _) in enumerate(fields)])
    return words.select("source", "by", F.inline(F.array_compact(named)))
