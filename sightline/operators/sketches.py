"""Sketches of an hour of a source, merged for any span: quantiles of lag and distinct values.

The exact way beside it counts each lag and each value and moves as many rows as there are different
ones; a sketch moves some KB for each hour of a source, whatever the number of events.
"""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sizes: items that a quantile sketch keeps on its lowest level, and the logarithm of a distinct sketch's registers.
QUANTILE_K = 800
DISTINCT_LG = 14
#: Errors of these sizes: of the rank of a quantile, as a share of all events (99 % confidence), and of a distinct count (one deviation).
RANK_ERROR = 2.296 / QUANTILE_K**0.9723
DISTINCT_ERROR = 1.04 / 2 ** (DISTINCT_LG / 2)


def lag_ms() -> Column:
    """Milliseconds from event to ingest, not under 0; null without both times."""
    gap = F.floor((F.unix_micros("ingest_ts") - F.unix_micros("event_ts")) / 1000)
    return F.when(gap.isNotNull(), F.greatest(F.lit(0), gap)).cast("long")


def hourly_sketches(events: DataFrame, value: str, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """keys, hour, docs, lags, vals: a row for each hour of a source, by event time (null for events without).

    lags: sketch of the lags in ms of events with both times; vals: sketch of the values that are not null.
    Rows of two tables, days or batches can be kept and united; ``merged_sketches`` adds them up.
    """
    rows = events.select(*keys, F.date_trunc("hour", "event_ts").alias("hour"), lag_ms().alias("lag"), F.col(value).alias("val"))
    return rows.groupBy(*keys, "hour").agg(F.count("*").alias("docs"), F.kll_sketch_agg_bigint("lag", F.lit(QUANTILE_K)).alias("lags"), F.hll_sketch_agg("val", F.lit(DISTINCT_LG)).alias("vals"))


def merged_sketches(sketches: DataFrame, *keys: str | Column) -> DataFrame:
    """keys, docs, lags, vals of all rows of each key."""
    return sketches.groupBy(*keys).agg(F.sum("docs").alias("docs"), F.kll_merge_agg_bigint("lags", F.lit(QUANTILE_K)).alias("lags"), F.hll_union_agg("vals").alias("vals"))


def within_span(sketches: DataFrame, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """The hours that begin at ``since`` or later and before ``until``."""
    kept = sketches if since is None else sketches.where(F.col("hour") >= F.lit(since))
    return kept if until is None else kept.where(F.col("hour") < F.lit(until))


def estimates(merged: DataFrame, share: float = 0.95) -> DataFrame:
    """Every column but the sketches, n_lags, lag_ms (the quantile; null without lags), n_values (estimated)."""
    n = F.coalesce(F.kll_sketch_get_n_bigint("lags"), F.lit(0).cast("long"))
    quantile = F.when(n > 0, F.kll_sketch_get_quantile_bigint("lags", F.lit(share)))
    own = [c for c in merged.columns if c not in ("lags", "vals")]
    return merged.select(*own, n.alias("n_lags"), quantile.alias("lag_ms"), F.coalesce(F.hll_sketch_estimate("vals"), F.lit(0).cast("long")).alias("n_values"))


def lag_counts(events: DataFrame, *keys: str | Column) -> DataFrame:
    """keys, lag, n: how often each lag occurs."""
    return events.withColumn("lag", lag_ms()).where("lag is not null").groupBy(*keys, "lag").agg(F.count("*").alias("n"))


def exact_quantile(counts: DataFrame, *keys: str, share: float = 0.95) -> DataFrame:
    """keys, n_lags, lag_ms: the nearest rank, by a running sum over the lags that occur."""
    by = Window.partitionBy(*keys)
    summed = counts.withColumns({"upto": F.sum("n").over(by.orderBy("lag")), "total": F.sum("n").over(by)})
    return summed.groupBy(*keys).agg(F.max("total").alias("n_lags"), F.min(F.when(F.col("upto") >= F.col("total") * F.lit(Decimal(str(share))), F.col("lag"))).alias("lag_ms"))


def exact_distinct(events: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, n_values: each value once before it is counted, so that no task holds a source's values."""
    return events.where(F.col(value).isNotNull()).select(*keys, value).distinct().groupBy(*keys).agg(F.count("*").alias("n_values"))


def rank_errors(counts: DataFrame, found: DataFrame, *keys: str, share: float = 0.95) -> DataFrame:
    """keys, rank_error: how far ``share`` lies outside the ranks that the estimate (keys, lag_ms) really has."""
    joined = counts.join(found.select(*keys, "lag_ms"), [*keys])
    ranks = joined.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("lag") < F.col("lag_ms"), F.col("n")).otherwise(0)).alias("below"), F.sum(F.when(F.col("lag") <= F.col("lag_ms"), F.col("n")).otherwise(0)).alias("upto"))
    return ranks.select(*keys, F.greatest(F.lit(0.0), F.col("below") / F.col("total") - share, share - F.col("upto") / F.col("total")).alias("rank_error"))
