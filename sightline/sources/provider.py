"""What a scan asks of a place that keeps rules and telemetry, and what it knows when that place can't tell."""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import nested, profile, resolve, verdicts
from ..operators.evidence import WINDOW_S
from .needed import needed_events
from .shared import written


class Provider:
    """Rules and sources are required; evidence that a provider doesn't have is None, and unavailable in a scan.

    Every answer is a DataFrame. Those about sources are asked only of sources that enabled rules match.
    """

    def rules(self) -> DataFrame:
        """rule_id, name, enabled, severity, patterns, interval_s, lookback_s, timestamp_override, required_fields."""
        raise NotImplementedError

    def sources(self) -> DataFrame:
        """source, docs, size_bytes, last_event."""
        raise NotImplementedError

    def freshness(self, requests: DataFrame) -> DataFrame | None:
        """requests: source, basis, max_stale_s -> source, status, last_event."""

    def lag(self, sources: DataFrame) -> DataFrame | None:
        """source, status, sample_count, p95_s, max_s."""

    def fields(self, sources: DataFrame) -> DataFrame | None:
        """source, status, fields (array)."""


class EventsProvider(Provider):
    """The default: everything from a table of events and one of rules.

    Inventory, freshness and lag are read from one profile, so from one pass over the events; lag is that of
    all events of the day before ``now``. Fields take a pass of their own over needed sources.
    """

    def __init__(self, events: DataFrame, rules: DataFrame, now: datetime, json_col: str | None = None):
        self._events, self._rules, self.now, self.json_col = events, rules, now, json_col

    def rules(self) -> DataFrame:
        return self._rules

    @cached_property
    def profile(self) -> DataFrame:
        return written(profile.source_profile(self._events, self.now), "profile")

    def sources(self) -> DataFrame:
        return profile.inventory(self.profile)

    def freshness(self, requests: DataFrame) -> DataFrame | None:
        return profile.bounded_freshness(self.profile, requests).select("source", "status", "last_event")

    def lag(self, sources: DataFrame) -> DataFrame | None:
        return profile.ingest_lag(self.profile, sources)

    def fields(self, sources: DataFrame) -> DataFrame | None:
        """Names at any depth that events of a source have; a source without any is incomplete."""
        if self.json_col is None:
            return None
        seen = nested.nested_snapshot(needed_events(self._events, sources), self.json_col).groupBy("source").agg(F.collect_set("field").alias("fields"))
        status = F.when(F.col("fields").isNull(), "incomplete").otherwise("assessed")
        return sources.select("source").join(seen, "source", "left").select("source", status.alias("status"), "fields")


def told(found: DataFrame | None, asked: DataFrame, columns: str) -> DataFrame:
    """A row for each source asked of: its evidence, else one with status unavailable and nulls.

    columns: the other columns, as DDL. A source told of twice is ambiguous, which is unavailable too.
    """
    names = asked.select("source").where("source is not null").distinct()
    if found is None:
        nulls = asked.sparkSession.createDataFrame([], columns).schema.fields
        return names.select("source", F.lit("unavailable").alias("status"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in nulls])
    own = [c for c in found.columns if c != "source"]
    one = found.groupBy("source").agg(F.count("*").alias("__n"), *[F.any_value(c).alias(c) for c in own])
    good = F.coalesce(F.col("__n") == 1, F.lit(False))
    kept = [F.when(good, F.col(c)).alias(c) for c in own if c != "status"]
    return names.join(one, "source", "left").select("source", F.when(good, F.coalesce("status", F.lit("unavailable"))).otherwise("unavailable").alias("status"), *kept)


class ProviderScan:
    """A scan of any provider. What several steps read is written once; unavailable evidence makes no verdict."""

    def __init__(self, provider: Provider, now: datetime, max_stale_s: float):
        self.provider, self.now, self.max_stale_s = provider, now, max_stale_s

    @cached_property
    def rules(self) -> DataFrame:
        return written(self.provider.rules(), "rules")

    @cached_property
    def inventory(self) -> DataFrame:
        return written(self.provider.sources(), "sources")

    @cached_property
    def edges(self) -> DataFrame:
        return written(resolve.pattern_edges(self.rules, self.inventory), "edges")

    @cached_property
    def needed(self) -> DataFrame:
        """The inventory's rows that enabled rules match."""
        used = self.edges.join(self.rules.where("enabled").select("rule_id"), "rule_id", "left_semi").select("source").distinct()
        return written(self.inventory.join(used, "source", "left_semi"), "needed")

    @cached_property
    def freshness(self) -> DataFrame:
        requests = resolve.freshness_clock(self.edges, self.rules).select("source", "basis", F.lit(self.max_stale_s).alias("max_stale_s"))
        return written(told(self.provider.freshness(requests), self.needed, "last_event timestamp"), "freshness")

    @cached_property
    def lag(self) -> DataFrame:
        return written(told(self.provider.lag(self.needed), self.needed, "sample_count long, p95_s double, max_s double"), "lag")

    @cached_property
    def fields(self) -> DataFrame:
        return written(told(self.provider.fields(self.needed), self.needed, "fields array<string>"), "fields")

    @property
    def sources(self) -> DataFrame:
        """The inventory; a last event that was assessed replaces its own."""
        fresh = self.freshness.where("status = 'assessed' and last_event is not null").select("source", F.col("last_event").alias("seen"))
        return self.inventory.join(fresh, "source", "left").withColumn("last_event", F.coalesce("seen", "last_event")).drop("seen")

    @property
    def health(self) -> DataFrame:
        """An empty window bounds the age of sources without a last event."""
        empty = self.freshness.where("status = 'assessed' and last_event is null").select("source", F.lit(float(WINDOW_S)).alias("window_s"))
        return verdicts.source_health(self.sources, self.now, float(self.max_stale_s), bounded=empty)

    @property
    def verdicts(self) -> DataFrame:
        """rule_id, name, severity, section, reason, detail, sources."""
        missing = verdicts.required_fields(self.edges, self.rules, self.fields)
        impaired = verdicts.rule_impairment(self.edges, self.rules, self.lag, missing)
        return verdicts.rule_verdicts(self.rules, self.edges, self.health, impaired=impaired)
