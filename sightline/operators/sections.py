"""Sections of a report in their order, with each row's place in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import rank_severity
from ..sources.shared import written


def section_order(section: str) -> list[Column]:
    """What a section's rows are ordered by. Rows that are equal in all of it have no order of their own."""
    text = lambda *names: F.concat(*[F.coalesce(n, F.lit("")) for n in names])
    orders = {
        "dead": lambda: [rank_severity("severity"), F.col("name"), F.col("rule_id")],
        "impaired": lambda: [rank_severity("severity"), F.col("name"), F.col("rule_id")],
        "unmapped": lambda: [F.col("name"), F.col("rule_id")],
        "partial": lambda: [F.col("rule_id"), F.col("expression"), F.col("selector")],
        "resolutions": lambda: [F.col("rule_id"), F.col("status"), text("expression", "selector"), F.col("diagnostic")],
        "evidence": lambda: [F.col("rule_id"), F.col("source"), F.col("status")],
    }
    return orders[section]()


def in_order(rows: DataFrame, section: str) -> DataFrame:
    return rows.orderBy(*section_order(section))


def placed(rows: DataFrame, section: str) -> DataFrame:
    """The rows with ``place``, from 1, in the section's order.

    Rows are cut into ranges, which are written so that their cuts can't change, and numbered in them; what
    lies before a range is a sum over one row for each range. No task holds more than a range.
    """
    order = section_order(section)
    ranges = written(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), section)
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.withColumn("place", inside).join(F.broadcast(starts), "__range").withColumn("place", F.col("place") + F.col("__before")).drop("__range", "__before")
