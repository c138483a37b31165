"""Only the events of sources that a scan needs reach it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many source names at most go into a filter of the scan.
LISTED = 5000


def needed_events(events: DataFrame, needed: DataFrame, source: str | Column = "source", listed: int = LISTED) -> DataFrame:
    """The events whose source is one of ``needed`` (source); null sources are never needed.

    Names are counted first. Up to ``listed`` of them become a filter that the scan is given, which skips
    partitions, row groups and files where the table is laid out by source. Beyond, a semi-join by shuffle takes its place,
    before which Spark drops rows by a bloom filter of the names where the events' side is large. Rows and columns stay as they are.
    """
    names = needed.select("source").where("source is not null").distinct()
    first = [r.source for r in names.limit(listed + 1).collect()]  # bounded
    key = F.col(source) if isinstance(source, str) else source
    if len(first) <= listed:
        return events.where(key.isin(first)) if first else events.where("false")
    keyed = events.withColumn("__needed", key)
    return keyed.join(names.withColumnRenamed("source", "__needed").hint("shuffle_hash"), "__needed", "left_semi").drop("__needed")
