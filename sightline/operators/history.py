"""What is learned across scans: volume baselines, schema drift, tuning, retention."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import volume_bucket

VERDICT = "source string, scan_ts timestamp, status string, rate double, mean double, std double, z double, samples int"


def volume_rate(counters: DataFrame) -> DataFrame:
    """Documents per hour between a source's scans; null on the first, unknown counts, resets and no time passed."""
    order = Window.partitionBy("source").orderBy("scan_ts")
    docs, before = F.col("docs"), F.lag("docs").over(order)
    hours = (F.unix_micros("scan_ts") - F.unix_micros(F.lag("scan_ts").over(order))) / 3.6e9
    return counters.withColumn("rate_per_hour", F.when((docs >= before) & (hours > 0), (docs - before) / hours))


def plain_sum(values) -> float:
    """Added one by one: sum() corrects its rounding from Python 3.12 on, which engines do not."""
    return reduce(add, values, 0.0)


def judge(ts, docs, last_ts, last, first, down: bool, samples: list[float], streak: int, warmup_s: float, hysteresis: int, min_samples: int, z: float):
    """One scan of a source: ((status, rate, mean, std, z, samples), the streak after it, whether its rate is a sample from now on).

    samples: rates that were accepted in the scan's bucket, the newest last.
    """
    if docs is None or last_ts is None or last is None or docs < last or ts <= last_ts:
        return ("unknown", None, None, None, None, None), 0, False
    rate = (docs - last) * 3600 / (ts - last_ts)
    if down:
        return ("maintenance", rate, None, None, None, None), streak, False
    n = len(samples)
    if warmup_s > 0 and ts - first < warmup_s:
        return ("warming", rate, None, None, None, n), streak, True
    if n < min_samples:
        return ("warming", rate, None, None, None, n), 0, True
    mean = plain_sum(samples) / n
    std = (plain_sum([(x - mean) ** 2 for x in samples]) / n) ** 0.5
    score = (rate - mean) / std if std > 0 else None
    low = score <= -z if score is not None else mean > 0 and rate < mean * 0.5
    streak = streak + 1 if low else 0
    return (("low" if streak >= hysteresis else "pending") if low else "ok", rate, mean, std, score, n), streak, not low


def fold_volume(state: dict, scans, warmup_s: float = 86400, hysteresis: int = 2, min_samples: int = 4, z: float = 3.0, keep: int = 64):
    """One source's scans (ts in seconds, bucket, docs or None, in_downtime), in order -> verdict tuples; state is updated.

    A rate that is low is no sample of its bucket, so what counts as normal depends on the verdicts before it.
    """
    for ts, bucket, docs, down in scans:
        first = state.setdefault("first", ts)
        last_ts, last = state.get("last", (None, None))
        state["last"] = (ts, docs)
        samples = state.setdefault("buckets", {}).setdefault(bucket, [])
        verdict, state["streak"], accepted = judge(ts, docs, last_ts, last, first, down, samples, state.get("streak", 0), warmup_s, hysteresis, min_samples, z)
        if accepted:
            samples.append(verdict[1])
            del samples[: -max(keep, min_samples)]
        yield ts, *verdict


def volume_baseline(counters: DataFrame, **options) -> DataFrame:
    """Verdict of every scan: ok, low, pending, warming, unknown or maintenance. counters: source, scan_ts, docs, in_downtime.

    Samples depend on earlier verdicts, which no window function expresses: a fold over each source's
    scans, one row per scan. A source's history is its scans, not its events.
    """
    import pandas as pd

    ready = counters.select("source", "scan_ts", volume_bucket("scan_ts").alias("bucket"), F.col("docs").cast("double").alias("docs"), "in_downtime")

    def fold(pdf):
        pdf = pdf.sort_values("scan_ts")
        rows = zip(pdf["scan_ts"].astype("datetime64[us]").astype("int64") / 1e6, pdf["bucket"], [None if pd.isna(d) else d for d in pdf["docs"]], pdf["in_downtime"])
        out = pd.DataFrame(list(fold_volume({}, rows, **options)), columns=["ts", "status", "rate", "mean", "std", "z", "samples"])
        out.insert(0, "source", pdf["source"].iloc[0])
        out.insert(1, "scan_ts", pdf["scan_ts"].to_numpy())
        return out.drop(columns="ts").astype({"samples": "Int32", "rate": "Float64", "mean": "Float64", "std": "Float64", "z": "Float64"})

    return ready.groupBy("source").applyInPandas(fold, VERDICT)


def baseline_tuning(samples: DataFrame) -> DataFrame:
    """source, buckets, samples, mean, std from (source, bucket, rate), most samples first."""
    return samples.groupBy("source").agg(
        F.count_distinct("bucket").alias("buckets"), F.count("*").alias("samples"), F.avg("rate").alias("mean"), F.stddev_pop("rate").alias("std")).orderBy(F.desc("samples"), "source")


def tuning_suggestion(stats: DataFrame, noisy: float = 0.75) -> DataFrame:
    """hysteresis, z, min_samples: wider if any source's deviation is over ``noisy`` of its mean."""
    any_noisy = F.coalesce(F.bool_or((F.col("mean") > 0) & (F.col("std") / F.col("mean") > noisy)), F.lit(False))
    return stats.agg(any_noisy.alias("n")).select(F.when(F.col("n"), 3).otherwise(2).alias("hysteresis"), F.when(F.col("n"), 4.0).otherwise(3.0).alias("z"), F.lit(4).alias("min_samples"))


def schema_drift(snapshots: DataFrame) -> DataFrame:
    """source, scan_ts, status, added[], removed[], type_changed[] against the last good snapshot before.

    snapshots: source, scan_ts, fetched, fields (map of field to sorted types). A failed read is unknown
    and no snapshot; the first, or one after a snapshot without fields, is warming.
    """
    good = F.when(F.col("fetched"), F.col("fields"))
    before = F.last(good, ignorenulls=True).over(Window.partitionBy("source").orderBy("scan_ts").rowsBetween(Window.unboundedPreceding, -1))
    j = snapshots.withColumn("before", before)
    old, new = F.map_keys("before"), F.map_keys("fields")
    changed = F.filter(F.array_intersect(new, old), lambda f: ~F.col("fields")[f].eqNullSafe(F.col("before")[f]))
    tell = F.coalesce(F.col("fetched") & (F.size("before") > 0), F.lit(False))
    none = F.array().cast("array<string>")
    parts = {"added": F.array_except(new, old), "removed": F.array_except(old, new), "type_changed": changed}
    j = j.withColumns({k: F.when(tell, F.array_sort(v)).otherwise(none) for k, v in parts.items()})
    drift = F.size("added") + F.size("removed") + F.size("type_changed") > 0
    status = F.when(~F.coalesce("fetched", F.lit(False)), "unknown").when(~tell, "warming").when(drift, "drift").otherwise("ok")
    return j.select("source", "scan_ts", status.alias("status"), *parts)


def retention_prune(history: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """Rows with activity in the last days. history: first_seen, and last_seen and schema_seen (null if never)."""
    active = F.coalesce(F.greatest("last_seen", "schema_seen"), "first_seen")
    return history.where(active >= F.lit(now - timedelta(days=days)))
