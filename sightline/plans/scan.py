"""All evidence of a scan from one pass over the events, and what follows from it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings, history, profile, resolve, verdicts
from ..sources.shared import written
from . import coverage as cv
from . import fixtures as fx
from .fixtures import COUNTERS, EDGES, EV, FIELD_DAYS, LAG_ALL, NOW, PAT, RES, RULES, SRC, with_
from .registry import query

us = F.unix_micros
TARGET, INSTANCE, BACKEND = "t", "", "b"


def latest_of(df: DataFrame, status: str) -> DataFrame:
    """(source, status under the given name) of each source's latest scan."""
    return df.groupBy("source").agg(F.max_by("status", "scan_ts").alias(status))


class Scan:
    """The events are read once, for the profile. What several steps read is written once.

    lost: sources, by a condition, that the inventory lacks though they resolve.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, lost: str = "false"):
        self.spark, self.rules, self.lost, self.types = spark, fx.rules(spark, sf_dir), lost, fx.field_types()
        self.profile = written(profile.source_profile(fx.events(spark, sf_dir), NOW, self.types, ("instance", "source")), "profile")

    @cached_property
    def all_sources(self) -> DataFrame:
        return written(profile.inventory(self.profile), "sources")

    @property
    def sources(self) -> DataFrame:
        return self.all_sources.where(f"not ({self.lost})")

    @property
    def lag(self) -> DataFrame:
        return profile.ingest_lag(self.profile, self.sources)

    @property
    def fields(self) -> DataFrame:
        """source, status, fields; sources that end in 08 could not be read."""
        seen = profile.fields_seen(self.profile, self.types, F.lit(0)).groupBy("source").agg(F.collect_set("field").alias("fields"))
        return seen.select("source", F.when(F.col("source").endswith("08"), "incomplete").otherwise("assessed").alias("status"), "fields")

    @property
    def volume(self) -> DataFrame:
        counted = profile.counters(self.profile)
        return history.volume_baseline(counted.withColumn("in_downtime", F.hour("scan_ts") == 3))

    @property
    def drift(self) -> DataFrame:
        days = profile.fields_seen(self.profile, self.types, F.to_date("hour"))
        types = days.groupBy("source", "by", "field").agg(F.array_sort(F.collect_set("type")).alias("types"))
        snaps = types.groupBy("source", F.col("by").alias("scan_ts")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "types")))).alias("fields"))
        return history.schema_drift(snaps.withColumn("fetched", F.dayofmonth("scan_ts") % 7 != 0))

    @cached_property
    def edges(self) -> DataFrame:
        """By names alone, without exclusions."""
        return written(resolve.pattern_edges(self.rules, self.sources), "edges")

    @cached_property
    def resolutions(self) -> DataFrame:
        return written(cv.resolutions_from(self.rules, self.all_sources), "resolutions")

    @cached_property
    def flags(self) -> DataFrame:
        return written(verdicts.rule_flags(self.resolutions, self.sources), "flags")

    @cached_property
    def resolved_edges(self) -> DataFrame:
        return written(resolve.resolved_edges(self.resolutions.where("not diagnostic"), self.rules, self.sources), "resolved-edges")

    @cached_property
    def health(self) -> DataFrame:
        """With each source's latest status of volume and schema."""
        h = verdicts.source_health(self.sources, NOW, float(fx.MAX_STALE_S))
        return written(h.join(latest_of(self.volume, "volume_status"), "source", "left").join(latest_of(self.drift, "schema_status"), "source", "left"), "health")

    def field_rows(self, edges: DataFrame) -> DataFrame:
        return verdicts.required_fields(edges, self.rules, self.fields)

    @cached_property
    def impaired(self) -> DataFrame:
        return written(verdicts.rule_impairment(self.edges, self.rules, self.lag, self.field_rows(self.edges)), "impaired")

    @cached_property
    def verdicts(self) -> DataFrame:
        """By names alone."""
        return written(verdicts.rule_verdicts(self.rules, self.edges, self.health, impaired=self.impaired), "verdicts")

    @property
    def native_verdicts(self) -> DataFrame:
        return verdicts.rule_verdicts(self.rules, self.resolved_edges, verdicts.source_health(self.sources, NOW, float(fx.MAX_STALE_S)), self.flags, self.impaired)

    @property
    def impairments(self) -> DataFrame:
        """(rule_id, source, reason, dependency) of impaired rules: each missing field of a source and each source too late."""
        i = self.impaired.join(self.verdicts.where("section = 'impaired'").select("rule_id"), "rule_id", "left_semi")
        fields = self.field_rows(self.edges).join(i.where("array_contains(reasons, 'missing-fields')").select("rule_id"), "rule_id", "left_semi")
        lacking = fields.select("rule_id", "source", F.lit("missing-fields").alias("reason"), F.explode("missing").alias("dependency"))
        return lacking.unionByName(i.select("rule_id", F.explode("lag_sources").alias("source"), F.lit("lag-blind-window").alias("reason"), F.lit("").alias("dependency")))

    @cached_property
    def findings(self) -> DataFrame:
        """Of all classes."""
        unused = verdicts.unused_telemetry(self.sources, self.edges, self.rules)
        partial = verdicts.partial_coverage(self.resolutions, self.flags)
        return written(findings.build_findings(self.verdicts, self.health, unused, partial, self.impairments, self.rules, TARGET, INSTANCE, BACKEND), "findings")


@query(with_(EV, SRC, LAG_ALL, COUNTERS, FIELD_DAYS, """hours AS (SELECT source, count(*) AS hours, max(n) AS busiest FROM (SELECT source, date_trunc('hour', event_ts) AS h, count(*) AS n FROM ev GROUP BY ALL) GROUP BY source),
  f AS (SELECT source, string_agg(DISTINCT field || ':' || type, ',' ORDER BY field || ':' || type) AS fields FROM field_days GROUP BY source)""")
  + f"""SELECT s.source, docs, size_bytes, epoch_us(last_event) AS last_us, (SELECT epoch_us(max(ingest_ts)) FROM ev e WHERE e.source = s.source AND ingest_ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND TIMESTAMP '{NOW}') AS arrived_us,
  sample_count, round(p95_s, 6) AS p95_s, round(max_s, 6) AS max_s, hours, busiest, fields FROM src s JOIN lag USING (source) JOIN hours USING (source) JOIN f USING (source)""")
def one_pass_evidence(spark, d):
    """Documents, freshness by ingest time, lag, hours and fields of every source, all from one scan."""
    scan = Scan(spark, d)
    p = scan.profile
    asked = scan.all_sources.select("source", F.lit("ingestion_time").alias("basis"), F.lit(fx.MAX_STALE_S).alias("max_stale_s"))
    hours = profile.hourly_volume(p).groupBy("source").agg(F.count("*").alias("hours"), F.max("n").alias("busiest"))
    fields = profile.fields_seen(p, scan.types, F.lit(0)).groupBy("source").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "field", "type"))), ",").alias("fields"))
    fresh = profile.bounded_freshness(p, asked).select("source", us("last_event").alias("arrived_us"))
    lag = scan.lag.select("source", "sample_count", F.round("p95_s", 6).alias("p95_s"), F.round("max_s", 6).alias("max_s"))
    out = scan.all_sources.select("source", "docs", "size_bytes", us("last_event").alias("last_us"))
    for part in (fresh, lag, hours, fields):
        out = out.join(part, "source")
    return out


NATIVE = (EV, RULES, PAT, EDGES, SRC, LAG_ALL, FIELD_DAYS, cv.FIELDS, cv.FROWS, cv.IMPAIRED, RES, cv.FLAGS, cv.NATIVE)


@query(with_(*NATIVE) + "SELECT rule_id, section, reason FROM native")
def rule_verdicts_native(spark, d):
    """Verdicts from resolved inputs, with lag and field evidence; sources that end in 04 are missing from the inventory."""
    return Scan(spark, d, "source like '%-04'").native_verdicts.select("rule_id", "section", "reason")
