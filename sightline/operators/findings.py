"""Findings: stable ids, policy, lifecycle, differences between scans, fleets, metrics and alerts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import OTHER_RANK, finding_id, rank_severity

# Fixed values of the report format.
CLASSES = ["dead-detection", "impaired-detection", "source-degraded", "volume-low", "schema-drift", "unused-telemetry", "partial-input"]
REGRESSION_CLASSES = CLASSES[:5]
SOURCE_CLASSES = ["source-degraded", "volume-low", "schema-drift", "unused-telemetry"]
SOURCE_STATUSES = ["ok", "stale", "empty", "unknown", "maintenance"]
RESOLUTION_STATUSES = ["resolved", "empty", "unsupported", "unavailable", "remote", "ambiguous", "incompatible"]
FINDING = ["finding_id", "class", "reason", "rule_id", "rule_name", "severity", "source", "dependency"]


def build_findings(verdicts: DataFrame, health: DataFrame, unused: DataFrame, partial: DataFrame, impaired: DataFrame, rules: DataFrame, target: str, instance: str | Column = "", backend: str = "") -> DataFrame:
    """One finding for each dead rule, impairment of a rule by source (and field), degraded, low or drifting source, unused source and empty selector.

    health: source, status, and volume_status and schema_status if known. impaired: rule_id, source, reason, dependency.
    """
    s = lambda x: F.lit(x) if isinstance(x, str) else x
    empty = F.lit("")

    def rows(df, finding_class, reason, rule=empty, name=empty, severity=empty, source=empty, dependency=empty):
        parts = (F.lit(finding_class).alias("class"), s(reason).alias("reason"), rule.alias("rule_id"), name.alias("rule_name"), severity.alias("severity"), source.alias("source"), dependency.alias("dependency"))
        return df.select(*parts)

    rule = rules.select(F.col("rule_id").alias("r"), F.col("name").alias("rn"), F.col("severity").alias("rs"))
    named = lambda df: df.join(rule, F.col("rule_id") == F.col("r"))
    c = F.col
    parts = [
        rows(verdicts.where("section = 'dead'"), "dead-detection", c("reason"), c("rule_id"), c("name"), c("severity")),
        rows(named(impaired), "impaired-detection", c("reason"), c("rule_id"), c("rn"), c("rs"), c("source"), c("dependency")),
        rows(health.where("status in ('stale', 'empty')"), "source-degraded", c("status"), source=c("source")),
        rows(unused, "unused-telemetry", "unused", source=c("source")),
        rows(named(partial), "partial-input", "selector-empty", c("rule_id"), c("rn"), c("rs"), dependency=F.coalesce(F.nullif("expression", F.lit("")), "selector")),
    ]
    if "volume_status" in health.columns:
        parts.append(rows(health.where("volume_status = 'low'"), "volume-low", "low", source=c("source")))
    if "schema_status" in health.columns:
        parts.append(rows(health.where("schema_status = 'drift'"), "schema-drift", "drift", source=c("source")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    who = F.lit(instance) if isinstance(instance, str) else instance
    return out.distinct().select(finding_id(F.lit(target), who, F.lit(backend), c("class"), c("rule_id"), c("reason"), c("source"), c("dependency")).alias("finding_id"), *FINDING[1:])


def apply_acceptances(findings: DataFrame, accept: DataFrame, now: datetime) -> DataFrame:
    """Adds acceptance: active or expired, null if there is none. accept: finding_id, expires_at."""
    state = accept.groupBy("finding_id").agg(F.max("expires_at").alias("expires_at"))
    return findings.join(state, "finding_id", "left").withColumn("acceptance", F.when(F.col("expires_at") > F.lit(now), "active").when(F.col("expires_at").isNotNull(), "expired")).drop("expires_at")


def apply_policy(findings: DataFrame, gate_classes: list[str], accept: DataFrame, now: datetime, floor: str | None = None) -> DataFrame:
    """Adds acceptance and gates: the class gates, no acceptance is active, and the severity reaches the floor.

    Source findings and unknown severities always reach it.
    """
    rank = rank_severity("severity")
    reached = F.lit(True) if floor is None else F.col("class").isin(*SOURCE_CLASSES) | (rank == OTHER_RANK) | (rank <= rank_severity(F.lit(floor)))
    state = apply_acceptances(findings, accept, now)
    return state.withColumn("gates", F.col("class").isin(*gate_classes) & (F.coalesce("acceptance", F.lit("")) != "active") & reached)


def gate_status(summary: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """instance, code: 1 if a finding gates (by policy), or else if any counter of trouble is above 0."""
    if findings is not None:
        gated = findings.groupBy("instance").agg(F.max(F.col("gates").cast("int")).alias("code"))
        return summary.select("instance").join(gated, "instance", "left").select("instance", F.coalesce("code", F.lit(0)).alias("code"))
    trouble = F.greatest("dead", "degraded", "volume_low", "drift", "impaired") > 0
    return summary.select("instance", trouble.cast("int").alias("code"))


def candidate_gate(findings: DataFrame, assessments: DataFrame, unsure: DataFrame) -> DataFrame:
    """instance, code for rules under test: 2 if evidence is missing or a rule is unmapped or remote, 1 if a finding on a rule gates.

    assessments: instance, name, status; unsure: instance, n.
    """
    bad = assessments.groupBy("instance").agg(F.bool_or(
        ((F.col("name") == "source_resolution") & (F.col("status") != "assessed")) | (F.col("name").isin("source_freshness", "required_fields", "ingest_lag") & F.col("status").isin("incomplete", "unavailable"))).alias("bad"))
    dirty = findings.where(~F.col("class").isin(*SOURCE_CLASSES)).groupBy("instance").agg(F.bool_or("gates").alias("dirty"))
    joined = bad.join(dirty, "instance", "left").join(unsure, "instance", "left")
    return joined.select("instance", F.when(F.col("bad") | (F.coalesce("n", F.lit(0)) > 0), 2).when(F.coalesce("dirty", F.lit(False)), 1).otherwise(0).alias("code"))


def finding_lifecycle(history: DataFrame) -> DataFrame:
    """scope_id, finding_id, first_seen, last_seen, occurrences, active, episodes from all scans (scope_id, scan_ts, finding_id).

    A finding that a later scan of its scope lacks has ended an episode.
    """
    scans = history.select("scope_id", "scan_ts").distinct().withColumn("n", F.row_number().over(Window.partitionBy("scope_id").orderBy("scan_ts")))
    last = scans.groupBy("scope_id").agg(F.max("n").alias("n_last"))
    seen = history.select("scope_id", "scan_ts", "finding_id").distinct().join(scans, ["scope_id", "scan_ts"]).join(last, "scope_id")
    gap = F.col("n") - F.lag("n").over(Window.partitionBy("scope_id", "finding_id").orderBy("n"))
    marked = seen.withColumn("starts", (F.coalesce(gap, F.lit(2)) > 1).cast("int"))
    return marked.groupBy("scope_id", "finding_id").agg(
        F.min("scan_ts").alias("first_seen"), F.max("scan_ts").alias("last_seen"), F.count("*").alias("occurrences"), (F.max("n") == F.max("n_last")).alias("active"), F.sum("starts").alias("episodes"))


def lifecycle_merge(state: DataFrame, findings: DataFrame, recovered: DataFrame, now: datetime) -> DataFrame:
    """The next state (scope_id, finding_id, first_seen, last_seen, occurrences, active, recovered_at).

    Findings of this scan are active; one that is gone becomes inactive only with a confirmed recovery
    (scope_id, finding_id): lost evidence is no recovery.
    """
    key, at = ["scope_id", "finding_id"], F.lit(now)
    new = findings.select(*key).distinct().withColumn("here", F.lit(True))
    ok = recovered.select(*key).distinct().withColumn("ok", F.lit(True))
    j = state.join(new, key, "full_outer").join(ok, key, "left")
    here = F.coalesce("here", F.lit(False))
    healed = ~here & F.coalesce("active", F.lit(False)) & F.coalesce("ok", F.lit(False))
    return j.select(
        *key, F.coalesce("first_seen", at).alias("first_seen"), F.when(here, at).otherwise(F.col("last_seen")).alias("last_seen"),
        (F.coalesce("occurrences", F.lit(0)) + here.cast("int")).alias("occurrences"), F.when(here, True).when(healed, False).otherwise(F.coalesce("active", F.lit(False))).alias("active"),
        F.when(here, None).when(healed, at).otherwise(F.col("recovered_at")).alias("recovered_at"))


def recovery_confirmed(previous: DataFrame, flags: DataFrame, verdicts: DataFrame, health: DataFrame, lag: DataFrame, field_rows: DataFrame, assessments: dict[str, str], rules: DataFrame, resolutions: DataFrame, unused_status: str) -> DataFrame:
    """previous findings with confirmed: positive evidence of this scan that what they found is gone.

    health: source, status, and volume_status, schema_status, consumers where known. assessments: name -> status.
    """
    sure = {k: F.lit(v == "assessed") for k, v in assessments.items()}
    got = lambda name: sure.get(name, F.lit(False))
    cols = {c: F.col(c) if c in health.columns else F.lit(None) for c in ("volume_status", "schema_status", "consumers")}
    src = health.select(F.col("source"), F.col("status").alias("h_status"), cols["volume_status"].cast("string").alias("h_volume"), cols["schema_status"].cast("string").alias("h_schema"), cols["consumers"].cast("long").alias("h_consumers"))
    rule = flags.select("rule_id", "has_resolved", F.col("uncertain").alias("r_uncertain"))
    live = verdicts.where("section in ('live', 'impaired')").select("rule_id").distinct().withColumn("r_alive", F.lit(True))
    margin = rules.select("rule_id", (F.col("lookback_s") - F.col("interval_s")).alias("margin"))
    lags = lag.select("source", F.col("status").alias("l_status"), "p95_s")
    fields = field_rows.select("rule_id", "source", F.col("status").alias("f_status"), "present")
    diag = resolutions.where("diagnostic").groupBy("rule_id", F.col("expression").alias("dependency")).agg(F.bool_and(F.col("status") == "resolved").alias("d_resolved"))
    j = previous.join(src, "source", "left").join(rule, "rule_id", "left").join(live, "rule_id", "left").join(margin, "rule_id", "left").join(lags, "source", "left").join(fields, ["rule_id", "source"], "left").join(diag, ["rule_id", "dependency"], "left")
    c, k, reason = F.col, F.col("class"), F.col("reason")
    known = ~F.coalesce("r_uncertain", F.lit(True))
    confirmed = (
        F.when((k == "dead-detection") & (reason == "starved"), got("source_resolution") & known & c("r_alive"))
        .when(k == "dead-detection", got("source_resolution") & known & c("has_resolved"))
        .when((k == "impaired-detection") & (reason == "missing-fields"), known & (c("f_status") == "assessed") & F.array_contains("present", c("dependency")))
        .when((k == "impaired-detection") & (reason == "lag-blind-window"), known & (c("l_status") == "assessed") & (c("p95_s") <= c("margin")))
        .when(k == "source-degraded", c("h_status") == "ok")
        .when(k == "volume-low", c("h_volume") == "ok")
        .when(k == "schema-drift", got("schema_drift") & (c("h_schema") == "ok"))
        .when(k == "unused-telemetry", F.lit(unused_status in ("complete", "legacy")) & (c("h_consumers") > 0))
        .when(k == "partial-input", got("source_resolution") & known & c("d_resolved"))
    )
    return j.select(*previous.columns, F.coalesce(confirmed, F.lit(False)).alias("confirmed"))


def comparable(old: DataFrame, new: DataFrame) -> DataFrame:
    """comparable, reason of two scans' metadata rows (schema_version, backend, instance, target_id, redaction_key, include[], exclude[])."""
    o, n = old.alias("o"), new.alias("n")
    plain = ["schema_version", "backend", "instance", "target_id", "redaction_key"]
    reason = F.coalesce(
        *[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(f"{c} differs")) for c in plain],
        *[F.when(~F.array_sort(f"o.{c}").eqNullSafe(F.array_sort(f"n.{c}")), F.lit(f"{c} differs")) for c in ("include", "exclude")],
        *[F.when(F.col(f"n.{c}").isNull(), F.lit(f"{c} is missing")) for c in ("schema_version", "backend", "target_id")],
    )
    return o.join(n, F.col("o.scan_key") == F.col("n.scan_key")).select(F.col("o.scan_key").alias("scan_key"), reason.isNull().alias("comparable"), F.coalesce(reason, F.lit("")).alias("reason"))


def scan_diff(old: DataFrame, new: DataFrame, confirmed: DataFrame | None = None, policy: bool = False) -> DataFrame:
    """finding_id, class, change, regression of findings that differ (finding_id, class, gates).

    change: new, newly_gated, no_longer_gated, recovered. A finding that is gone recovered only if
    confirmed (finding_id) has it, when that is given.
    """
    o, n = old.select("finding_id", F.col("class").alias("o_class"), F.col("gates").alias("o_gates")), new.select("finding_id", F.col("class").alias("n_class"), F.col("gates").alias("n_gates"))
    j = o.join(n, "finding_id", "full_outer")
    ok = F.lit(True)
    if confirmed is not None:
        j, ok = j.join(confirmed.select("finding_id", F.lit(True).alias("ok")).distinct(), "finding_id", "left"), F.coalesce("ok", F.lit(False))
    change = (
        F.when(F.col("o_class").isNull(), "new").when(F.col("n_class").isNull(), F.when(ok, "recovered"))
        .when(~F.col("o_gates") & F.col("n_gates"), "newly_gated").when(F.col("o_gates") & ~F.col("n_gates"), "no_longer_gated"))
    worse = (change == "newly_gated") | ((change == "new") & (F.col("n_gates") if policy else F.col("n_class").isin(*REGRESSION_CLASSES)))
    return j.select("finding_id", F.coalesce("n_class", "o_class").alias("class"), change.alias("change"), F.coalesce(worse, F.lit(False)).alias("regression")).where("change is not null")


def source_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """source, change: added or removed."""
    added = new.select("source").exceptAll(old.select("source")).withColumn("change", F.lit("added"))
    return added.unionByName(old.select("source").exceptAll(new.select("source")).withColumn("change", F.lit("removed")))


def union_reports(*reports: DataFrame) -> DataFrame:
    """Sections of several tenants as one table."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def fleet_rollup(verdicts: DataFrame, instances: DataFrame) -> DataFrame:
    """rule_name, severity, dead_in, impaired_in, of: in how many tenants a rule, by name, is dead or impaired.

    verdicts: instance, name, severity, section; instances: instance, ok. Worst first.
    """
    good = instances.where("ok")
    rows = verdicts.where("section in ('dead', 'impaired')").join(good.select("instance"), "instance", "left_semi")
    by_rule = rows.groupBy(F.col("name").alias("rule_name")).agg(
        F.min_by("severity", F.struct("instance", "severity")).alias("severity"), F.count_if(F.col("section") == "dead").alias("dead_in"), F.count_if(F.col("section") == "impaired").alias("impaired_in"))
    # One row of a count joins to every row.
    of = good.agg(F.count("*").alias("of"))
    return by_rule.join(F.broadcast(of)).orderBy(F.desc("dead_in"), rank_severity("severity"), "rule_name")


def repeats(rollup: DataFrame, k: int = 10) -> DataFrame:
    """The k rules dead or impaired in most tenants, of those in two or more."""
    shared = rollup.where((F.col("of") > 1) & (F.col("dead_in") + F.col("impaired_in") >= 2))
    return shared.orderBy(F.desc("dead_in"), F.desc("impaired_in"), rank_severity("severity"), "rule_name").limit(k)


def fleet_unused_assessment(statuses: DataFrame, errors: DataFrame) -> DataFrame:
    """status of a fleet from its instances' statuses (instance, status) and errors (instance)."""
    s = F.col("status")
    agg = statuses.agg(F.count("*").alias("n"), F.bool_or(s == "unavailable").alias("bad"), F.bool_or(s == "not-applicable").alias("na"), F.bool_or(s.isin("complete", "legacy")).alias("known"), F.bool_or(s == "legacy").alias("legacy"))
    joined = agg.join(F.broadcast(errors.agg(F.count("*").alias("failed"))))
    out = F.when((F.col("failed") > 0) | (F.col("n") == 0) | F.col("bad") | (F.col("na") & F.col("known")), "unavailable").when(F.col("na"), "not-applicable").when(F.col("legacy"), "legacy").otherwise("complete")
    return joined.select(out.alias("status"))


def metrics_long(scans: DataFrame, health: DataFrame, verdicts: DataFrame, unused: DataFrame, resolutions: DataFrame) -> DataFrame:
    """metric, labels (JSON), value: gauges of the fleet, of each instance and of each source.

    scans: instance, ok, scan_ts, unused_status; health: instance, source, status, age_s, lower_bound,
    consumers, volume_status and volume_z and schema_status (null without a baseline or snapshot);
    verdicts: instance, section; unused: instance, size_bytes; resolutions: instance, status, n. An
    instance whose scan failed is down and has no other gauge.
    """
    good = scans.where("ok")
    h = health.join(good.select("instance"), "instance", "left_semi")

    def gauges(rows, labels, **values):
        """A row for each value of a row that is not null."""
        each = F.explode(F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value.cast("double"))]))
        return rows.select(F.to_json(F.struct(*labels)).alias("labels"), each.alias("metric", "value")).where("value is not null").select("metric", "labels", "value")

    def by_status(counts, metric, statuses):
        wanted = good.select("instance", F.explode(F.array(*[F.lit(s) for s in statuses])).alias("status"))
        return gauges(wanted.join(counts, ["instance", "status"], "left"), ["instance", "status"], **{metric: F.coalesce("n", F.lit(0))})

    fleet = scans.agg(F.coalesce(F.bool_and("ok"), F.lit(False)).alias("up"), F.max("scan_ts").alias("t"))
    sections = verdicts.groupBy("instance").agg(*[F.count_if(F.col("section") == s).alias(s) for s in ("dead", "impaired", "unmapped")])
    own = good.join(sections, "instance", "left").join(unused.groupBy("instance").agg(F.sum("size_bytes").alias("b")), "instance", "left")
    status = F.col("status")
    return union_reports(
        gauges(fleet, [], up=F.col("up"), last_scan_timestamp_seconds=F.unix_seconds("t")),
        gauges(scans, ["instance"], instance_up=F.col("ok")),
        by_status(h.groupBy("instance", "status").agg(F.count("*").alias("n")), "sources", SOURCE_STATUSES),
        by_status(resolutions, "input_resolutions", RESOLUTION_STATUSES),
        gauges(own, ["instance"], **{f"{s}_rules": F.coalesce(s, F.lit(0)) for s in ("dead", "impaired", "unmapped")}, unused_bytes=F.coalesce("b", F.lit(0)), unused_assessed=F.coalesce(F.col("unused_status").isin("complete", "legacy"), F.lit(False))),
        gauges(h, ["instance", "source"], freshness_seconds=F.when(status.isin("ok", "stale", "maintenance") & ~F.col("lower_bound"), F.col("age_s")), consumers=F.coalesce("consumers", F.lit(0)), volume_zscore=F.col("volume_z"), volume_low=F.col("volume_status") == "low", schema_drift=F.col("schema_status") == "drift"),
    )


def metric_alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """alert, labels, ts, firing. metrics: ts, metric, labels, value; rules: alert, metric, op, threshold, for_s.

    An alert fires while its condition has held at every sample of the last for_s seconds, and samples
    reach back that far.
    """
    v, t = F.col("value"), F.col("threshold")
    cond = F.when(F.col("op") == ">", v > t).when(F.col("op") == "=", v == t).otherwise(v < t)
    j = metrics.join(rules, "metric").withColumns({"on": cond.cast("int"), "s": F.unix_seconds("ts")})
    order = Window.partitionBy("alert", "labels").orderBy("s")
    # The last sample at which the condition did not hold; before the first sample it's unknown.
    off = F.max(F.when(F.col("on") == 0, F.col("s"))).over(order)
    start = F.min("s").over(order)
    held = (F.col("on") == 1) & F.when(off.isNull(), F.col("s") - start >= F.col("for_s")).otherwise(F.col("s") - off > F.col("for_s"))
    return j.select("alert", "labels", "ts", held.alias("firing"))


def unassessed_checks(assessments: DataFrame, disabled: list[str]) -> DataFrame:
    """Checks that gave no assessment, without those that are switched off on purpose."""
    return assessments.where((F.col("status") != "assessed") & ~((F.col("status") == "disabled") & F.col("name").isin(*disabled)))


def runtime_assessments(checks: DataFrame) -> DataFrame:
    """instance, name, status, n_bad of each check from rows (instance, name, status): all, some or no evidence read."""
    s = F.col("status")
    by = checks.groupBy("instance", "name").agg(F.count("*").alias("n"), F.count_if(s == "unavailable").alias("gone"), F.count_if(s == "disabled").alias("off"), F.count_if(~s.isin("assessed", "disabled")).alias("n_bad"))
    status = F.when(F.col("off") == F.col("n"), "disabled").when(F.col("gone") == F.col("n"), "unavailable").when(F.col("n_bad") > 0, "incomplete").otherwise("assessed")
    return by.select("instance", "name", status.alias("status"), "n_bad")


def advisory_warnings(slices: DataFrame, runs: DataFrame) -> DataFrame:
    """kind, name, status of advisory rows that are not fine."""
    a = slices.where(~F.col("status").isin("ok", "maintenance")).select(F.lit("slice").alias("kind"), F.col("name"), F.col("status"))
    b = runs.where(~((F.col("status") == "assessed") & (F.col("run_status") == "Succeeded"))).select(F.lit("run").alias("kind"), F.col("name"), F.col("status"))
    return a.unionByName(b)
