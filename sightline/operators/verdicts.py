"""Health of sources and verdicts on rules. Only positive evidence makes a finding; unknown never does."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import rank_severity
from .evidence import seconds, telemetry_evidence
from .resolve import blast_radius, matches, missing_targets, windows_on_event_time

DEGRADED = ("stale", "empty")
UNCERTAIN = ("unsupported", "unavailable", "ambiguous")


def max_stale_for(sources: DataFrame, policy_source: DataFrame, default_s: float) -> DataFrame:
    """source, max_stale_s: of the first policy pattern (ordinal, pattern, max_stale_s) that matches, else the default."""
    hit = matches(policy_source, sources).join(policy_source, "pattern")
    first = hit.groupBy("source").agg(F.min_by("max_stale_s", "ordinal").alias("own"))
    return sources.select("source").join(first, "source", "left").select("source", F.coalesce("own", F.lit(float(default_s))).alias("max_stale_s"))


def downtime_match(sources: DataFrame, downtime: DataFrame, now: datetime) -> DataFrame:
    """source, in_downtime. downtime: patterns[], days[] (0 is Sunday; none: all), start_min, end_min, tz.

    A window that ends before it starts goes on after midnight, as part of the day it began.
    """
    local = F.from_utc_timestamp(F.lit(now).cast("timestamp"), F.col("tz"))
    minute, day = F.hour(local) * 60 + F.minute(local), F.dayofweek(local) - 1
    on = lambda d: (F.size("days") == 0) | F.array_contains("days", d)
    same = (F.col("start_min") < F.col("end_min")) & (minute >= F.col("start_min")) & (minute < F.col("end_min")) & on(day)
    over = (F.col("start_min") > F.col("end_min")) & (((minute >= F.col("start_min")) & on(day)) | ((minute < F.col("end_min")) & on(F.pmod(day + 6, F.lit(7)))))
    open_ = downtime.where(same | over).select(F.explode("patterns").alias("pattern"))
    hit = matches(open_, sources).select("source").distinct().withColumn("hit", F.lit(True))
    return sources.select("source").join(hit, "source", "left").select("source", F.coalesce("hit", F.lit(False)).alias("in_downtime"))


def source_health(sources: DataFrame, now: datetime, max_stale: DataFrame | float, downtime: DataFrame | None = None, bounded: DataFrame | None = None) -> DataFrame:
    """source, docs, size_bytes, status, age_s, lower_bound.

    bounded: source, window_s of assessed empty windows; a last event older than such a window of at
    least the allowed age is stale, with the window as a lower bound of its age.
    """
    s = sources.join(max_stale, "source", "left") if isinstance(max_stale, DataFrame) else sources.withColumn("max_stale_s", F.lit(float(max_stale)))
    s = s.join(downtime, "source", "left") if downtime is not None else s.withColumn("in_downtime", F.lit(False))
    s = s.join(bounded, "source", "left") if bounded is not None else s.withColumn("window_s", F.lit(None).cast("double"))
    age = F.lit(now.timestamp() if now.tzinfo else (now - datetime(1970, 1, 1)).total_seconds()) - seconds("last_event")
    bound = F.coalesce(F.col("last_event").isNull() & (F.col("window_s") >= F.col("max_stale_s")) & (F.col("max_stale_s") > 0), F.lit(False))
    plain = F.when(F.col("docs") == 0, "empty").when(bound, "stale").when(F.col("last_event").isNull(), "unknown").when(age > F.col("max_stale_s"), "stale").otherwise("ok")
    status = F.when(F.coalesce("in_downtime", F.lit(False)) & plain.isin(*DEGRADED), "maintenance").otherwise(plain)
    return s.select("source", "docs", "size_bytes", status.alias("status"), F.when(bound, F.col("window_s")).otherwise(age).alias("age_s"), bound.alias("lower_bound"))


def starved(edges: DataFrame, health: DataFrame) -> DataFrame:
    """rule_id, starved (every source degraded), degraded[], matched[]."""
    bad = F.coalesce(F.col("status").isin(*DEGRADED), F.lit(False))
    return edges.join(health.select("source", "status"), "source", "left").groupBy("rule_id").agg(
        F.bool_and(bad).alias("starved"), F.array_sort(F.collect_set(F.when(bad, F.col("source")))).alias("degraded"), F.array_sort(F.collect_set("source")).alias("matched"))


def rule_flags(resolutions: DataFrame, sources: DataFrame) -> DataFrame:
    """Flags of each rule with rows: resolutions of rule_id, ordinal, diagnostic, selector, status, detail, resolved_sources."""
    real, status = ~F.col("diagnostic"), F.col("status")
    first = F.min_by(F.struct("status", "detail"), F.when(status.isin(*UNCERTAIN), F.col("ordinal")))
    names = lambda cond: F.array_sort(F.collect_set(F.when(cond & (status == "incompatible") & (F.coalesce("selector", F.lit("")) != ""), F.col("selector"))))
    flags = resolutions.groupBy("rule_id").agg(
        F.bool_or(real & (status == "resolved")).alias("has_resolved"), F.bool_or(real & (status == "empty")).alias("has_empty"),
        F.bool_or(status == "incompatible").alias("has_incompatible"), F.bool_or(status == "remote").alias("remote"),
        F.bool_or(status.isin(*UNCERTAIN)).alias("unsure"), first.alias("first"),
        names(F.col("diagnostic")).alias("by_diagnostic"), names(real).alias("by_rule"))
    lost = missing_targets(resolutions.where(real), sources)
    joined = flags.join(lost, "rule_id", "left")
    unsure_status = F.coalesce(F.when(F.col("unsure"), F.col("first.status")), F.when(F.col("targets").isNotNull(), F.lit("ambiguous")))
    return joined.select(
        "rule_id", "has_resolved", "has_empty", "has_incompatible", "remote", unsure_status.alias("uncertain_status"),
        F.when(F.col("unsure"), F.col("first.detail")).when(F.col("targets").isNotNull(), "one or more resolved targets were not present in the source inventory").alias("uncertain_detail"),
        (F.col("remote") | unsure_status.isNotNull()).alias("uncertain"),
        F.when(F.size("by_diagnostic") > 0, F.col("by_diagnostic")).otherwise(F.col("by_rule")).alias("incompatible_sources"),
        F.coalesce("targets", F.array().cast("array<string>")).alias("missing_targets"))


def required_fields(edges: DataFrame, rules: DataFrame, field_evidence: DataFrame) -> DataFrame:
    """rule_id, source, status, present[], missing[]. field_evidence: source, status, fields[]."""
    wanted = edges.join(rules.where("size(required_fields) > 0").select("rule_id", "required_fields"), "rule_id")
    joined = wanted.join(field_evidence, "source", "left")
    known, none = F.coalesce(F.col("status") == "assessed", F.lit(False)), F.array().cast("array<string>")
    asked = F.array_sort(F.array_distinct("required_fields"))
    return joined.select(
        "rule_id", "source", F.coalesce("status", F.lit("unavailable")).alias("status"),
        F.when(known, F.array_intersect(asked, F.coalesce("fields", none))).otherwise(none).alias("present"),
        F.when(known, F.array_except(asked, F.coalesce("fields", none))).otherwise(none).alias("missing"))


def rule_impairment(edges: DataFrame, rules: DataFrame, lag: DataFrame, field_rows: DataFrame | None = None) -> DataFrame:
    """rule_id, reasons[], missing_fields[], lag_sources[], p95_s, max_s of impaired rules.

    Missing fields need assessed fields of every matched source. A source whose p95 lag is beyond
    lookback - interval blinds rules that window on event time.
    """
    none = F.array().cast("array<string>")
    margin = F.col("lookback_s") - F.col("interval_s")
    eligible = windows_on_event_time() & (F.col("interval_s") > 0) & (margin >= 0) & (F.col("lookback_s") > 0)
    late = edges.join(rules.where(eligible).select("rule_id", margin.alias("margin")), "rule_id").join(lag.where("status = 'assessed' and sample_count > 0"), "source").where("p95_s > margin")
    by_lag = late.groupBy("rule_id").agg(F.array_sort(F.collect_set("source")).alias("lag_sources"), F.max("p95_s").alias("p95_s"), F.max("max_s").alias("max_s"))
    if field_rows is None:
        both = by_lag.withColumn("missing_fields", none)
    else:
        known = F.bool_and(F.col("status") == "assessed").alias("known")
        fields = field_rows.groupBy("rule_id").agg(known, F.array_sort(F.array_distinct(F.flatten(F.collect_list("missing")))).alias("missing_fields")).where("known and size(missing_fields) > 0").drop("known")
        both = by_lag.join(fields, "rule_id", "full_outer")
    missing, lagging = F.coalesce("missing_fields", none), F.coalesce("lag_sources", none)
    reasons = F.array_compact(F.array(F.when(F.size(missing) > 0, F.lit("missing-fields")), F.when(F.size(lagging) > 0, F.lit("lag-blind-window"))))
    return both.select("rule_id", reasons.alias("reasons"), missing.alias("missing_fields"), lagging.alias("lag_sources"), "p95_s", "max_s")


def rule_verdicts(rules: DataFrame, edges: DataFrame, health: DataFrame, flags: DataFrame | None = None, impaired: DataFrame | None = None) -> DataFrame:
    """One row for each section an enabled rule appears in: rule_id, name, severity, section, reason, detail, sources[].

    Sections: dead, impaired, unmapped, remote, live. With flags (native resolution) a rule can be
    remote and unmapped at once. Without, pattern names alone decide.
    """
    none = F.array().cast("array<string>")
    r = rules.where("enabled").select("rule_id", "name", "severity", "patterns").join(starved(edges, health), "rule_id", "left")
    if impaired is None:
        r = r.withColumns({"reasons": F.lit(None).cast("array<string>")})
    else:
        r = r.join(impaired.select("rule_id", "reasons"), "rule_id", "left")
    row = lambda section, reason="", detail="", sources=None: F.struct(F.lit(section).alias("section"), F.lit(reason).alias("reason") if isinstance(reason, str) else reason.alias("reason"), F.coalesce(F.lit(detail) if isinstance(detail, str) else detail, F.lit("")).alias("detail"), F.coalesce(none if sources is None else sources, none).alias("sources"))
    matched = F.col("matched").isNotNull()
    nothing = F.array().cast("array<struct<section:string,reason:string,detail:string,sources:array<string>>>")
    reasons = F.coalesce("reasons", none)
    if flags is None:
        alive = F.when(F.size(reasons) > 0, F.array(row("impaired", F.array_join(reasons, ","), "", F.col("matched")))).otherwise(F.array(row("live", "", "", F.col("matched"))))
        rows = (
            F.when(F.size("patterns") == 0, F.array(row("unmapped", "unsupported")))
            .when(~matched & F.exists("patterns", lambda p: F.contains(p, F.lit(":"))), F.array(row("remote", "remote")))
            .when(~matched, F.array(row("dead", "disconnected")))
            .when(F.col("starved"), F.array(row("dead", "starved", "", F.col("degraded"))))
            .otherwise(alive)
        )
    else:
        r = r.join(flags, "rule_id", "left")
        bad = F.coalesce("incompatible_sources", none)
        all_reasons = F.when(F.size(bad) > 0, F.concat(reasons, F.array(F.lit("source-plan-incompatible")))).otherwise(reasons)
        alive = F.when(F.size(all_reasons) > 0, F.array(row("impaired", F.array_join(all_reasons, ","), "", F.col("matched")))).otherwise(F.array(row("live", "", "", F.col("matched"))))
        first = F.concat(
            F.when(F.col("remote"), F.array(row("remote", "remote"))).otherwise(nothing),
            F.when(F.col("uncertain_status").isNotNull(), F.array(row("unmapped", F.col("uncertain_status"), F.col("uncertain_detail")))).otherwise(nothing))
        verdict = (
            F.when(F.col("uncertain"), nothing)
            .when(~matched & F.col("has_resolved"), F.array(row("unmapped", "ambiguous", "resolved targets were not present in the source inventory")))
            .when(~matched & F.col("has_incompatible"), F.array(row("dead", "source-plan-incompatible", "", bad)))
            .when(~matched & F.col("has_empty"), F.array(row("dead", "disconnected")))
            .when(~matched, F.array(row("unmapped", "unsupported", "no input-resolution evidence was returned")))
            .when(F.col("starved"), F.array(row("dead", "starved", "", F.col("degraded"))))
            .otherwise(alive)
        )
        rows = F.when(F.col("has_resolved").isNull(), F.array(row("unmapped", "unsupported", "no input-resolution evidence was returned"))).otherwise(F.concat(first, verdict))
    return r.select("rule_id", "name", "severity", F.inline(rows))


def partial_coverage(resolutions: DataFrame, flags: DataFrame) -> DataFrame:
    """Empty selectors of rules that resolve otherwise: rule_id, selector, expression."""
    sure = flags.where("has_resolved and not uncertain").select("rule_id")
    return resolutions.where("diagnostic and status = 'empty'").join(sure, "rule_id", "left_semi").select("rule_id", "selector", "expression")


def unused_telemetry(sources: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Stored sources that no enabled rule reads: source, size_bytes, disabled_consumers; the largest first."""
    used = sources.join(blast_radius(edges, rules), "source", "left")
    unused = used.where((F.coalesce("consumers", F.lit(0)) == 0) & telemetry_evidence())
    return unused.select("source", "size_bytes", F.coalesce("disabled", F.lit(0)).alias("disabled_consumers")).orderBy(F.desc("size_bytes"), "source")


def unused_assessment(rules: DataFrame, resolutions: DataFrame | None, sources: DataFrame, skip: bool = False) -> Column | DataFrame:
    """status: whether unused telemetry can be told at all (complete, legacy, unavailable, not-applicable)."""
    on = rules.where("enabled").select("rule_id")
    if skip or resolutions is None:
        return on.agg(F.when(F.lit(skip), "not-applicable").otherwise("legacy").alias("status"))
    rows = resolutions.join(missing_targets(resolutions.where("not diagnostic"), sources), "rule_id", "left")
    status, real = F.col("status"), ~F.col("diagnostic")
    unsure = status.isin(*UNCERTAIN)
    empty_target = real & (status == "resolved") & ((F.size("resolved_sources") == 0) | F.col("targets").isNotNull())
    by_rule = rows.groupBy("rule_id").agg(F.bool_or(unsure | empty_target | (~real & (status == "remote"))).alias("bad"), F.bool_or(real).alias("any"))
    bad = on.join(by_rule, "rule_id", "left").agg(F.bool_or(F.coalesce(F.col("bad") | ~F.col("any"), F.lit(True))).alias("bad"))
    return bad.select(F.when(F.coalesce("bad", F.lit(False)), "unavailable").otherwise("complete").alias("status"))


def resolution_counts(resolutions: DataFrame) -> DataFrame:
    """status, n: authoritative rows; incompatible ones by distinct diagnostic inputs of each rule, if there are any."""
    plain = resolutions.where("not diagnostic and status <> 'incompatible'").groupBy("status").agg(F.count("*").alias("n"))
    own = resolutions.where("status = 'incompatible'").groupBy("rule_id").agg(
        F.count_distinct(F.when(F.col("diagnostic"), F.coalesce("selector", F.lit("")))).alias("named"), F.count_if(~F.col("diagnostic")).alias("rows"))
    bad = own.select(F.lit("incompatible").alias("status"), F.when(F.col("named") > 0, F.col("named")).otherwise(F.col("rows")).alias("n")).groupBy("status").agg(F.sum("n").alias("n"))
    return plain.unionByName(bad)


def summary_rollup(health: DataFrame, verdicts: DataFrame, rules: DataFrame, unused: DataFrame) -> DataFrame:
    """All counters of a scan as rows: counter, n."""
    count = lambda df, **k: df.agg(*[F.count_if(v).alias(n) for n, v in k.items()])
    s = F.col("status")
    a = count(health, sources=s.isNotNull(), healthy_sources=s == "ok", degraded_sources=s.isin(*DEGRADED), unknown_sources=s == "unknown", maintenance_sources=s == "maintenance")
    k = F.col("section")
    b = count(verdicts, dead_detections=k == "dead", impaired_detections=k == "impaired", unmapped_rules=k == "unmapped", remote_rules=k == "remote")
    c = count(rules, rules=F.col("rule_id").isNotNull(), enabled_rules=F.col("enabled"))
    d = unused.agg(F.count("*").alias("unused_sources"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("unused_bytes"))
    rows = [df.select(F.explode(F.create_map(*[x for n in df.columns for x in (F.lit(n), F.col(n).cast("long"))])).alias("counter", "n")) for df in (a, b, c, d)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def source_attention(health: DataFrame) -> DataFrame:
    """source, reasons[] of sources that need attention. health: source, status, volume_status, schema_status."""
    reasons = F.array_compact(F.array(
        F.when(F.col("status").isin(*DEGRADED), F.col("status")), F.when(F.col("volume_status") == "low", F.lit("volume low")), F.when(F.col("schema_status") == "drift", F.lit("schema drift"))))
    return health.select("source", reasons.alias("reasons")).where("size(reasons) > 0")


def scope_listing(health: DataFrame, in_scope: DataFrame) -> DataFrame:
    """All sources with a flag whether they are listed; verdicts never depend on it."""
    return health.join(in_scope.select("source").distinct().withColumn("listed", F.lit(True)), "source", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def visible_unmapped(unmapped: DataFrame, kind: str = "correlation", candidate: bool = False) -> DataFrame:
    """Unmapped rules without the built-in kind that has no query, unless candidates are examined."""
    return unmapped if candidate else unmapped.where(F.coalesce(F.col("rule_type"), F.lit("")) != kind)


def severity_order(rows: DataFrame) -> DataFrame:
    """The most severe first, then by name and id."""
    return rows.orderBy(rank_severity("severity"), "name", "rule_id")


