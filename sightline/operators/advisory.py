"""Advisory evidence: transform jobs and their runs, rule executions, lineage and provenance."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bin sizes that jobs can have, and allowances.
BIN_MINUTES = [20, 30, 60, 120, 180, 360, 720, 1440]
RETRY_S, CLOCK_S = 8 * 3600, 30
SCHEDULED_GRACE_S, LIVE_GRACE_S = 300, 120


def job_run_freshness(jobs: DataFrame, runs: DataFrame, now: datetime, days: int = 7) -> DataFrame:
    """job_id, name, run_status, status, detail from the latest run of each job in the last days.

    jobs: job_id, name, bin_min, delay_min, modified_at. runs: name, run_at, run_status, rule_modified_at.
    Runs name their job, so a name of several jobs tells nothing; a run must belong to the job's present definition.
    """
    recent = runs.where(F.col("run_at").between(F.lit(now - timedelta(days=days)), F.lit(now)) & F.col("run_status").isin("Succeeded", "Failed"))
    last = recent.groupBy("name").agg(F.max(F.struct("run_at", "run_status", "rule_modified_at")).alias("r"))
    names = jobs.groupBy("name").agg(F.count("*").alias("n_jobs"))
    j = jobs.join(names, "name").join(last, "name", "left")
    run, mod = F.col("r.run_at"), F.col("modified_at")
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(run)) / 1e6
    detail = (
        F.when(F.col("n_jobs") > 1, "job name is not unique").when(~F.col("bin_min").isin(*BIN_MINUTES) | (F.col("delay_min") < 0), "schedule is not supported")
        .when(run.isNull(), "no run in the window").when(run < mod, "run is older than the definition")
        .when((F.col("r.rule_modified_at") > run) | (F.unix_micros("r.rule_modified_at") < F.unix_micros(mod) - CLOCK_S * 1_000_000), "run belongs to another definition")
        .when((F.col("r.run_status") == "Succeeded") & (age > (F.col("bin_min") + F.col("delay_min")) * 60 + RETRY_S), "last success is too old"))
    return j.select("job_id", "name", F.col("r.run_status").alias("run_status"), F.when(detail.isNull(), "assessed").otherwise("incomplete").alias("status"), F.coalesce(detail, F.lit("")).alias("detail"))


def execution_identity(outcomes: DataFrame, rules: DataFrame, runs: DataFrame, now: datetime, days: int = 7) -> DataFrame:
    """Outcomes with needs_proof resolved only by a fresh success of exactly that rule and kind.

    outcomes: rule_id, input, status, needs_proof. rules: rule_id, kind, interval_s, modified_at. runs: rule_id, kind, run_at, status.
    """
    recent = runs.where(F.col("run_at") >= F.lit(now - timedelta(days=days)))
    last = recent.groupBy("rule_id", "kind").agg(F.max(F.struct("run_at", F.col("status").alias("run_status"))).alias("r"))
    j = outcomes.join(rules.select("rule_id", "kind", "interval_s", "modified_at"), "rule_id").join(last, ["rule_id", "kind"], "left")
    live = F.col("kind") == "NRT"
    schedule = F.when(live, F.col("interval_s") == 60).otherwise(F.col("interval_s").between(300, 14 * 86400))
    grace = F.when(live, LIVE_GRACE_S).otherwise(SCHEDULED_GRACE_S)
    run, at = F.col("r.run_at"), F.lit(now).cast("timestamp")
    age = (F.unix_micros(at) - F.unix_micros(run)) / 1e6
    proof = F.coalesce(schedule & (F.col("r.run_status") == "Success") & (run <= at) & (run >= F.col("modified_at")) & (age <= F.col("interval_s") + grace), F.lit(False))
    return j.select("rule_id", "input", F.when(F.col("needs_proof") & ~proof, "unavailable").otherwise(F.col("status")).alias("status"), (F.col("needs_proof") & proof).alias("proved"))


def source_lineage(jobs: DataFrame, edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """job_id, output, input, status, detail of jobs whose output an enabled rule reads, a row for each input.

    jobs: job_id, active, provisioning, status_code, inputs[], output. edges: source of enabled rules. catalog: table, plan, provisioned.
    """
    key = lambda c: F.lower(F.trim(c))
    read = edges.select(key("source").alias("key")).distinct()
    used = jobs.withColumn("key", key("output")).join(read, "key", "left_semi")
    tables = catalog.select(key("table").alias("key"), "plan", "provisioned")
    dest = tables.select("key", F.col("plan").alias("d_plan"), F.col("provisioned").alias("d_ok"))
    wide = used.join(dest, "key", "left").drop("key").select("*", F.explode_outer("inputs").alias("input")).withColumn("key", key("input")).join(tables, "key", "left")
    detail = (
        F.when(~F.coalesce("active", F.lit(False)), "job is not active").when(F.col("provisioning") != "Succeeded", "job is not provisioned")
        .when(F.coalesce("status_code", F.lit("")) != "", "job reports an error").when(F.col("input").isNull(), "inputs are not resolved")
        .when(F.col("d_ok").isNull(), "destination is missing").when(~F.col("d_ok"), "destination is not provisioned")
        .when(F.col("d_plan").isin("Basic", "Auxiliary"), "destination plan is incompatible").when(F.col("provisioned").isNull(), "input is missing"))
    return wide.select("job_id", "output", "input", F.when(detail.isNull(), "assessed").otherwise("incomplete").alias("status"), F.coalesce(detail, F.lit("")).alias("detail"))


def rule_provenance(rules: DataFrame, templates: DataFrame, packages: DataFrame, catalog: DataFrame) -> DataFrame:
    """rule_id, package, status, detail: the package of a rule's template and whether its version is current.

    rules: rule_id, template. templates: template, package. packages: package, version. catalog: package, version.
    Ids match without case, whole or by their last path segment.
    """
    key = lambda c: F.lower(F.trim(F.element_at(F.split(F.rtrim(c, F.lit("/")), "/"), -1)))
    t = templates.select(key(F.col("template")).alias("t"), key(F.col("package")).alias("p")).distinct().groupBy("t").agg(F.min("p").alias("p"), F.count("*").alias("n"))
    p = packages.groupBy(key(F.col("package")).alias("p")).agg(F.max("version").alias("installed"))
    c = catalog.groupBy(key(F.col("package")).alias("p")).agg(F.max("version").alias("current"))
    j = rules.withColumn("t", key(F.col("template"))).join(t, "t", "left").join(p, "p", "left").join(c, "p", "left")
    detail = (
        F.when(F.coalesce("template", F.lit("")) == "", "rule has no template").when(F.col("n").isNull(), "template is not installed").when(F.col("n") > 1, "template is in several packages")
        .when(F.col("installed").isNull(), "package is not installed").when(F.col("current").isNull(), "package is not in the catalog"))
    text = F.when(F.col("installed") == F.col("current"), F.format_string("installed %s; current", F.col("installed"))).otherwise(F.format_string("installed %s; current %s", F.col("installed"), F.col("current")))
    return j.select("rule_id", F.col("p").alias("package"), F.when(detail.isNull(), "assessed").otherwise("incomplete").alias("status"), F.coalesce(detail, text).alias("detail"))
