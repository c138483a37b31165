"""Evidence per source from raw events: one aggregation each, before any join with rules.

events: source, event_id, event_ts, ingest_ts. Measurements that are unknown are null; statuses never are.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import volume_bucket

WINDOW_S = 24 * 3600
SAMPLE = 500


def seconds(ts: str | Column) -> Column:
    return F.unix_micros(ts) / 1e6


def telemetry_evidence() -> Column:
    """A source counts as stored telemetry if it has documents or a last event."""
    return F.coalesce(F.col("docs") > 0, F.lit(False)) | F.col("last_event").isNotNull()


def source_inventory(events: DataFrame) -> DataFrame:
    """source, docs, size_bytes, last_event; system sources (names from ``.``) are left out."""
    named = events.where(~F.col("source").startswith("."))
    return named.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size_bytes").alias("size_bytes"), F.max("event_ts").alias("last_event"))


def last_event(events: DataFrame) -> DataFrame:
    return events.groupBy("source").agg(F.max("event_ts").alias("last_event"))


def backing_rollup(partitions: DataFrame) -> DataFrame:
    """Physical partitions (name, docs, store_bytes, total_bytes) rolled up into their logical stream."""
    dated = F.regexp_extract("name", r"^\.ds-(.+)-\d{4}\.\d{2}\.\d{2}-\d+$", 1)
    plain = F.regexp_extract("name", r"^\.ds-(.+)-\d+$", 1)
    stream = F.coalesce(F.nullif(dated, F.lit("")), F.nullif(plain, F.lit("")), F.col("name"))
    total = partitions.groupBy(stream.alias("source")).agg(F.sum("docs").alias("docs"), F.sum("store_bytes").alias("store"), F.sum("total_bytes").alias("total"))
    return total.where(~F.col("source").startswith(".")).select("source", "docs", F.when(F.col("store") == 0, F.col("total")).otherwise(F.col("store")).alias("size_bytes"))


def bounded_freshness(events: DataFrame, requests: DataFrame, now: datetime, window_s: int = WINDOW_S) -> DataFrame:
    """requests: source, basis (event_time, ingestion_time, mixed), max_stale_s -> source, status, last_event.

    Only events of the window before ``now`` are read. A window without events is assessed with a null
    last event, a bound: the last one is older. It's incomplete if the window is shorter than
    max_stale_s, and for mixed clocks.
    """
    since = F.lit(now - timedelta(seconds=window_s))
    recent = events.where((F.greatest("event_ts", "ingest_ts") >= since) & (F.least("event_ts", "ingest_ts") <= F.lit(now)))
    inside = lambda ts: F.max(F.when(F.col(ts).between(since, F.lit(now)), F.col(ts)))
    found = recent.groupBy("source").agg(inside("event_ts").alias("by_event"), inside("ingest_ts").alias("by_ingest"))
    return freshness_of(found, requests, window_s)


def freshness_of(found: DataFrame, requests: DataFrame, window_s: int) -> DataFrame:
    """source, basis, status, last_event of requests from the last events inside the window (source, by_event, by_ingest)."""
    last = F.when(F.col("basis") == "event_time", F.col("by_event")).when(F.col("basis") == "ingestion_time", F.col("by_ingest"))
    short = last.isNull() & (F.col("max_stale_s") > window_s)
    status = F.when((F.col("basis") == "mixed") | short, "incomplete").otherwise("assessed")
    return requests.join(found, "source", "left").select("source", "basis", status.alias("status"), last.alias("last_event"))


def recent_sample(events: DataFrame, k: int = SAMPLE) -> DataFrame:
    """The k most recently ingested events of each source; ties go to the larger id."""
    order = Window.partitionBy("source").orderBy(F.col("ingest_ts").desc(), F.col("event_id").desc())
    return events.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def ingest_lag(events: DataFrame, sources: DataFrame, now: datetime, k: int = SAMPLE, exact: bool = False) -> DataFrame:
    """source, status, sample_count, p95_s, max_s of ingest lag in the 24 hours before ``now``.

    The p95 is the nearest rank. It's of the k events ingested last, or of all of them (``exact``), which are
    counted by lag before they are put in order.
    """
    paired = events.where(F.col("event_ts").isNotNull() & F.col("ingest_ts").between(F.lit(now - timedelta(seconds=WINDOW_S)), F.lit(now)))
    lag = F.greatest(F.lit(0), F.floor((F.unix_micros("ingest_ts") - F.unix_micros("event_ts")) / 1000))
    if exact:
        return lag_of_counts(paired.groupBy("source", lag.alias("lag_ms")).agg(F.count("*").alias("n")), sources)
    sample = recent_sample(paired, k)
    found = sample.withColumn("lag_ms", lag).groupBy("source").agg(
        F.count("*").alias("sample_count"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY lag_ms)").alias("p95_ms"), F.max("lag_ms").alias("max_ms"))
    status = F.when(F.col("docs") == 0, "disabled").when(F.coalesce("sample_count", F.lit(0)) == 0, "incomplete").otherwise("assessed")
    return sources.select("source", "docs").join(found, "source", "left").select(
        "source", status.alias("status"), F.coalesce("sample_count", F.lit(0)).alias("sample_count"), (F.col("p95_ms") / 1000).alias("p95_s"), (F.col("max_ms") / 1000).alias("max_s"))


def lag_of_counts(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """source, status, sample_count, p95_s, max_s from how often each lag occurs (source, lag_ms, n)."""
    by = Window.partitionBy("source")
    summed = counts.withColumns({"upto": F.sum("n").over(by.orderBy("lag_ms")), "total": F.sum("n").over(by)})
    found = summed.groupBy("source").agg(F.max("total").alias("sample_count"), F.min(F.when(F.col("upto") * 100 >= F.col("total") * 95, F.col("lag_ms"))).alias("p95_ms"), F.max("lag_ms").alias("max_ms"))
    status = F.when(F.col("docs") == 0, "disabled").when(F.col("sample_count").isNull(), "incomplete").otherwise("assessed")
    return sources.select("source", "docs").join(found, "source", "left").select(
        "source", status.alias("status"), F.coalesce("sample_count", F.lit(0)).alias("sample_count"), (F.col("p95_ms") / 1000).alias("p95_s"), (F.col("max_ms") / 1000).alias("max_s"))


def schema_snapshot(events: DataFrame, json_col: str = "props") -> DataFrame:
    """source, field, types: the sorted types of each top-level JSON field."""
    fields = events.select("source", F.col(json_col).alias("j"), F.explode(F.json_object_keys(json_col)).alias("field"))
    raw = F.trim(F.call_function("get_json_object", F.col("j"), F.concat(F.lit("$['"), F.col("field"), F.lit("']"))))
    kind = (
        F.when(raw.isNull(), "null").when(F.regexp_like(raw, F.lit(r"\A-?\d+\z")), "long").when(F.regexp_like(raw, F.lit(r"\A-?\d+(\.\d+)?([eE][+-]?\d+)?\z")), "double")
        .when(raw.isin("true", "false"), "boolean").when(raw.startswith("{"), "object").when(raw.startswith("["), "array").otherwise("string"))
    return fields.select("source", "field", kind.alias("type")).groupBy("source", "field").agg(F.array_sort(F.collect_set("type")).alias("types"))


def field_availability(partition_fields: DataFrame, wanted: DataFrame) -> DataFrame:
    """partition_fields: source, partition, field, ok; wanted: source, field, or only field -> source, field, available.

    A field is available if every partition of the source has it and can search it. Wanted fields with a
    source, as rules ask for them, are joined; those without are asked of every source.
    """
    partitions = partition_fields.groupBy("source").agg(F.count_distinct("partition").alias("n_partitions"))
    have = partition_fields.groupBy("source", "field").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"), F.count_distinct("partition").alias("n"))
    if "source" in wanted.columns:
        asked = wanted.select("source", "field").distinct().join(partitions, "source")
    else:  # the wanted ones are a single row
        asked = partitions.join(F.broadcast(wanted.agg(F.collect_set("field").alias("wanted")))).select("source", "n_partitions", F.explode("wanted").alias("field"))
    found = asked.join(have, ["source", "field"], "left")
    return found.select("source", "field", F.coalesce(F.col("ok") & (F.col("n") == F.col("n_partitions")), F.lit(False)).alias("available"))


def source_evidence_attach(sources: DataFrame, freshness: DataFrame, lag: DataFrame) -> DataFrame:
    """Sources with their evidence; an assessed freshness replaces the last event."""
    fresh = freshness.select("source", F.col("status").alias("freshness_status"), F.col("last_event").alias("fresh"))
    lags = lag.select("source", F.col("status").alias("lag_status"), "sample_count", "p95_s", "max_s")
    joined = sources.join(fresh, "source", "left").join(lags, "source", "left")
    return joined.withColumn("last_event", F.when(F.col("freshness_status") == "assessed", F.col("fresh")).otherwise(F.col("last_event"))).drop("fresh")


def deviation(values: Column) -> Column:
    """Population deviation of an array of numbers, each added in order by x - mean before and after it.

    stddev_pop adds by x - mean and its share, whose last bit differs, so that a score of exactly -z isn't told as low.
    """
    nothing = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def add(a: Column, x: Column) -> Column:
        n = a["n"] + 1
        mean = a["mean"] + (x - a["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["squares"] + (x - mean) * (x - a["mean"])).alias("squares"))

    return F.aggregate(F.transform(values, lambda x: x.cast("double")), nothing, add, lambda a: F.when(a["n"] > 0, F.sqrt(a["squares"] / a["n"])))


def volume_baseline_simple(events: DataFrame, z: float = 3.0, k: int = 64) -> DataFrame:
    """Hourly counts against the mean and deviation of up to k earlier hours of the same weekday and hour."""
    hourly = events.groupBy("source", F.date_trunc("hour", "event_ts").alias("hour")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("source", volume_bucket("hour")).orderBy("hour").rowsBetween(-k, -1)
    known = hourly.withColumns({"mean": F.avg("n").over(before), "std": deviation(F.collect_list("n").over(before))})
    score = F.when(F.col("std") > 0, (F.col("n") - F.col("mean")) / F.col("std"))
    low = F.when(F.col("std") > 0, score <= -z).otherwise(F.coalesce((F.col("std") == 0) & (F.col("mean") > 0) & (F.col("n") < F.col("mean") / 2), F.lit(False)))
    return known.select("source", "hour", "n", score.alias("z"), F.coalesce(low, F.lit(False)).alias("low"))


def run_coverage(events: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_id, source, empirical and closed_form share of events that a scheduled rule catches.

    Runs happen every interval; an event at T that arrives lag later is caught if the last run whose
    lookback still covers T comes after it arrived. That depends on a source and a schedule only, so
    events meet the distinct schedules of their source, are summed before anything moves, and rules
    join to the sums.
    """
    schedule = ["source", "interval_s", "lookback_s"]
    wanted = edges.join(rules.select("rule_id", "lookback_s", "interval_s"), "rule_id").where("interval_s > 0")
    timed = events.select("source", F.floor(F.unix_micros("event_ts") / 1_000_000).alias("t"), F.greatest(F.lit(0), F.floor((F.unix_micros("ingest_ts") - F.unix_micros("event_ts")) / 1_000_000)).alias("lag"))
    last_run = F.floor((F.col("t") + F.col("lookback_s")) / F.col("interval_s")) * F.col("interval_s")
    caught = (last_run >= F.col("t") + F.col("lag")).cast("int")
    closed = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("lookback_s") - F.col("lag")) / F.col("interval_s")))
    shares = timed.join(wanted.select(*schedule).distinct(), "source").groupBy(*schedule).agg(F.avg(caught).alias("empirical"), F.avg(closed).alias("closed_form"))
    return wanted.join(shares, schedule).groupBy("rule_id", "source").agg(F.first("empirical").alias("empirical"), F.first("closed_form").alias("closed_form"))


def bin_reconciliation(raw: DataFrame, rollup: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    """bin, keys, raw_n, rollup_n, match: raw counts of each bin against the stored ones."""
    bins = raw.groupBy(F.window("event_ts", f"{minutes} minutes").start.alias("bin"), *keys).agg(F.count("*").alias("raw_n"))
    return bins.join(rollup, ["bin", *keys], "full_outer").select("bin", *keys, "raw_n", "rollup_n", F.col("raw_n").eqNullSafe(F.col("rollup_n")).alias("match"))


def slice_freshness(events: DataFrame, predicates: DataFrame, edges: DataFrame, now: datetime, fields: list[str]) -> DataFrame:
    """Last event of each rule's slice of a source. predicates: rule_id, source, term_no, field, values[].

    An event is in the slice if it meets every term; only sources that the rule resolves to count. Rules
    with the same terms on a source share a slice, and events are reduced to the last one of each
    combination of their fields before they meet any.
    """
    term = F.struct("term_no", "field", F.array_sort(F.array_distinct("values")).alias("values"))
    sets = predicates.join(edges, ["rule_id", "source"], "left_semi").groupBy("rule_id", "source").agg(F.array_sort(F.collect_set(term)).alias("terms"))
    flat = sets.select("source", "terms").distinct().select("source", "terms", F.inline("terms")).select("source", "terms", "term_no", "field", F.explode("values").alias("value"))
    asked = [F.col(f).cast("string").alias(f) for f in fields]
    last_of = events.select("source", "event_ts", *asked).groupBy("source", *fields).agg(F.max("event_ts").alias("event_ts"))
    held = last_of.select("source", "event_ts", F.struct(*fields).alias("values_of"), F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])).alias("field", "value"))
    met = held.join(flat, ["source", "field", "value"]).groupBy("source", "terms", "values_of").agg(F.count_distinct("term_no").alias("n_met"), F.max("event_ts").alias("event_ts"))
    last = met.where(F.col("n_met") == F.size(F.array_distinct("terms.term_no"))).groupBy("source", "terms").agg(F.max("event_ts").alias("last_event"))
    return sets.join(last, ["source", "terms"], "left").select("rule_id", "source", "last_event")
