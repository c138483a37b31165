"""All queries over the derived telemetry, and the flagship one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import evidence, resolve, verdicts
from . import coverage, fixtures, lifecycle, scalars, scan, streams, wider  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "dead_rules"]


def dead_rules(spark: SparkSession, sf_dir: str, max_stale_s: float = fixtures.MAX_STALE_S) -> DataFrame:
    """Which enabled rules are dead, and why; the most severe first."""
    rules = fixtures.rules(spark, sf_dir)
    sources = evidence.source_inventory(fixtures.events(spark, sf_dir))
    edges = resolve.pattern_edges(rules, sources)
    health = verdicts.source_health(sources, fixtures.NOW, max_stale_s)
    dead = verdicts.rule_verdicts(rules, edges, health).where("section = 'dead'")
    return verdicts.severity_order(dead).select("rule_id", "name", "severity", "reason", "sources")
