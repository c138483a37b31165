"""Reading events, rules and job tables; writing report sections, metrics and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = """rule_id string, id string, name string, enabled boolean, severity string, risk_score double, type string, language string,
  index array<string>, data_view_id string, query string, `from` string, interval string, timestamp_override string, updated_at string"""


def scan_events(spark: SparkSession, path: str, source: str | Column, event_col: str, ingest_col: str | Column | None = None, format: str = "parquet", schema: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """source, event_ts, ingest_ts and the columns asked for; only these reach the scan.

    Times without a zone become timestamps in the session's zone, which streams with watermarks need.
    """
    reader = spark.read.format(format)
    df = (reader.schema(schema) if schema else reader).load(path)
    ingest = F.col(ingest_col) if isinstance(ingest_col, str) else ingest_col
    by = F.expr(source) if isinstance(source, str) else source
    ingested = F.lit(None).cast("timestamp") if ingest is None else ingest.cast("timestamp")
    return df.select(by.alias("source"), F.col(event_col).cast("timestamp").alias("event_ts"), ingested.alias("ingest_ts"), *columns)


def normalise_rules(raw: DataFrame, shape: str) -> DataFrame:
    """rule_id, name, enabled, severity, patterns, interval, lookback from one of three inventories.

    index: index-pattern rules. detector: fields nested in ``detector``, each falling back to the row's
    own. scheduled: rules with ISO durations and properties.
    """
    from ..functions.expr import detector_severity, normalize_severity, parse_interval, parse_iso_duration, parse_lookback

    c = F.col
    if shape == "index":
        return raw.select("rule_id", "name", F.coalesce("enabled", F.lit(False)).alias("enabled"), normalize_severity("severity").alias("severity"), F.coalesce("index", F.array().cast("array<string>")).alias("patterns"), parse_interval("interval").alias("interval_s"), parse_lookback("from").alias("lookback_s"))
    if shape == "detector":
        own = lambda f: F.coalesce(c(f"detector.{f}"), c(f))
        inputs = F.array_distinct(F.filter(F.transform(F.flatten(F.transform(own("inputs"), lambda i: i["indices"])), lambda p: F.trim(p)), lambda p: p != ""))
        return raw.select(c("id").alias("rule_id"), own("name").alias("name"), F.coalesce(own("enabled"), F.lit(False)).alias("enabled"), detector_severity(own("severities")).alias("severity"), inputs.alias("patterns"), F.lit(0).cast("bigint").alias("interval_s"), F.lit(0).cast("bigint").alias("lookback_s"))
    if shape == "scheduled":
        live = c("kind") == "NRT"
        return raw.where(c("kind").isin("Scheduled", "NRT")).select(
            "rule_id", "name", F.coalesce("enabled", F.lit(False)).alias("enabled"), normalize_severity("severity").alias("severity"), F.array().cast("array<string>").alias("patterns"),
            F.when(live, 60).otherwise(parse_iso_duration("query_frequency")).cast("bigint").alias("interval_s"), F.when(live, 60).otherwise(parse_iso_duration("query_period")).cast("bigint").alias("lookback_s"))
    raise ValueError(f"unknown shape {shape}")


def scan_rules(spark: SparkSession, path: str, shape: str = "index", schema: str = RULE_SCHEMA, multiline: bool = False) -> DataFrame:
    return normalise_rules(spark.read.schema(schema).option("multiLine", multiline).json(path), shape)


def candidate_rules(raw: DataFrame) -> DataFrame:
    """Proposed rules: always enabled; the id is rule_id, id or name; rows of export trailers and without any id go."""
    identity = F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in ("rule_id", "id", "name")])
    trailer = F.col("exported_count").isNotNull() if "exported_count" in raw.columns else F.lit(False)
    kept = raw.where(~trailer).withColumns({"rule_id": identity, "enabled": F.lit(True)})
    return kept.where(F.col("rule_id").isNotNull())


def scan_candidate_rules(spark: SparkSession, path: str, multiline: bool = True, schema: str = RULE_SCHEMA) -> DataFrame:
    """Rule files of one object, an array, or (``multiline`` off) an object per line."""
    return candidate_rules(spark.read.schema(f"{schema}, exported_count long").option("multiLine", multiline).json(path))


def write_report(sections: dict[str, DataFrame], path: str, scan_id: str, format: str = "parquet") -> None:
    """A table for each section, partitioned by scan; a scan written again replaces itself."""
    for name, df in sections.items():
        rows = df.withColumn("scan_id", F.lit(scan_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").format(format).save(f"{path}/{name}")


def nested_json(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, body: all rows of a key as one JSON array, in the order of their first columns."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in (key, *order)])))
    return df.groupBy(key).agg(F.to_json(rows).alias("body"))


def write_history(df: DataFrame, path: str, target_id: str, scan_id: str) -> None:
    """Append a scan's rows to a target's history; the same scan again replaces itself."""
    rows = df.withColumns({"target_id": F.lit(target_id), "scan_id": F.lit(scan_id)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("target_id", "scan_id").parquet(path)


def read_history(spark: SparkSession, path: str, target_id: str, schema: str) -> DataFrame:
    """A target's rows of all scans; without any history an empty table."""
    full = f"{schema}, target_id string, scan_id string"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path).where(F.col("target_id") == target_id)
