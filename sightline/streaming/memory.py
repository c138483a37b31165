"""A scan that runs on and remembers: evidence and findings are carried from batch to batch.

Each batch of events becomes a profile of its own, which is written first. The scan adds it to the
profile that the last committed scan left, judges the whole, delivers the report, and only then commits:
the profile so far, and every finding's first and last sight, number of sightings and recovery.

    parts/batch=N              profile of the batch
    state/profile/batch=N      profile of all batches up to N
    state/findings/batch=N     what is known of every finding after scan N
    report/<table>/batch=N     what scan N found
    commits/batch=N            scan N is done
    up/batch=N                 1, or 0 and why not

A batch that is delivered again starts from the commit before it and writes the same folders, so it
changes nothing. A scan that fails commits nothing and ends nothing; the next one also adds the parts
that were not committed. States before the last but one commit are deleted. Hours older than
``keep_days`` are forgotten, and so are findings not seen for as long.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import findings as fd
from ..operators import profile as pf

KEYS = ["scope_id", "finding_id"]
ABOUT = ["class", "reason", "rule_id", "rule_name", "severity", "source", "dependency"]
FINDINGS = "scope_id string, finding_id string, first_seen timestamp, last_seen timestamp, occurrences long, active boolean, recovered_at timestamp, " + ", ".join(f"{c} string" for c in ABOUT)
#: (profile of all events so far, findings known before, time of the scan) -> the report's tables; ``findings`` (KEYS and ABOUT) and ``recovered`` (KEYS) are needed.
Judge = Callable[[DataFrame, DataFrame, datetime], dict[str, DataFrame]]


class Memory:
    """The folders of one scan."""

    def __init__(self, spark: SparkSession, path: str, fields: list, keys: tuple[str, ...] = ("source",), keep_days: int = 30):
        self.spark, self.path, self.fields, self.keys, self.keep_days = spark, path, fields, keys, keep_days

    def _fs(self, at: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _batches(self, folder: str) -> list[int]:
        where, fs = self._fs(f"{self.path}/{folder}")
        if not fs.exists(where):
            return []
        return sorted(int(s.getPath().getName()[6:]) for s in fs.listStatus(where) if s.getPath().getName().startswith("batch="))

    def _done(self) -> list[int]:
        return [b for b in self._batches("commits") if self._fs(f"{self.path}/commits/batch={b}/_SUCCESS")[1].exists(self._fs(f"{self.path}/commits/batch={b}/_SUCCESS")[0])]

    def write(self, df: DataFrame, folder: str, batch: int) -> DataFrame:
        at = f"{self.path}/{folder}/batch={batch}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def read(self, folder: str, batch: int, schema: StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/batch={batch}")

    def last_commit(self, before: int | None = None) -> int | None:
        """The last committed batch, or the last one before a batch."""
        return max((b for b in self._done() if before is None or b < before), default=None)

    def findings(self, batch: int | None) -> DataFrame:
        """What is known after a committed batch; nothing before the first."""
        return self.spark.createDataFrame([], FINDINGS) if batch is None else self.read("state/findings", batch, FINDINGS)

    def report(self, table: str, schema: StructType | str) -> DataFrame:
        """A table of the last committed report."""
        return self.read(f"report/{table}", self.last_commit(), schema)

    def deliver(self, judge: Judge, events: DataFrame, batch: int) -> None:
        part = self.write(pf.source_profile(events, None, self.fields, self.keys), "parts", batch)
        try:
            base = self.last_commit(batch)
            held = part
            for b in self._batches("parts"):
                if (base is None or b > base) and b < batch:
                    held = held.unionByName(self.read("parts", b, part.schema))
            if base is not None:
                held = held.unionByName(self.read("state/profile", base, part.schema))
            whole = self.write(pf.merged(self._kept(held), self.keys, len(self.fields)), "state/profile", batch)
            now = whole.agg(F.max("last_event")).first()[0]
            if now is not None:
                self._scan(judge, whole, self.findings(base), now, batch)
                for old in self._batches("commits"):
                    if base is not None and old < base:
                        self._forget(old)
            up, why = 1, ""
        except Exception as e:  # the failure is data here: it must not end the watch
            up, why = 0, str(e)[:500]
        self.write(self.spark.createDataFrame([(up, why)], "up int, error string").coalesce(1), "up", batch)

    def _kept(self, rows: DataFrame) -> DataFrame:
        last = rows.agg(F.max("last_event")).first()[0]
        if last is None:
            return rows
        since = F.when(F.col("part") == "lag", F.lit(last - timedelta(days=1, hours=1))).otherwise(F.lit(last - timedelta(days=self.keep_days)))
        return rows.where(F.col("hour").isNull() | (F.col("hour") >= since))

    def _scan(self, judge: Judge, whole: DataFrame, before: DataFrame, now: datetime, batch: int) -> None:
        tables = {name: self.write(df, f"report/{name}", batch) for name, df in judge(whole, before, now).items()}
        found = tables["findings"]
        state = fd.lifecycle_merge(before.select(*KEYS, "first_seen", "last_seen", "occurrences", "active", "recovered_at"), found, tables["recovered"], now)
        about = found.select(*KEYS, *ABOUT).unionByName(before.select(*KEYS, *ABOUT)).groupBy(*KEYS).agg(*[F.first(c).alias(c) for c in ABOUT])
        known = state.join(about, KEYS).where(F.col("last_seen") >= F.lit(now - timedelta(days=self.keep_days)))
        self.write(known.select(*[c.split()[0] for c in FINDINGS.split(", ")]), "state/findings", batch)
        self.write(self.spark.createDataFrame([(now,)], "scan_ts timestamp").coalesce(1), "commits", batch)

    def _forget(self, batch: int) -> None:
        for folder in ("parts", "state/profile", "state/findings"):
            where, fs = self._fs(f"{self.path}/{folder}/batch={batch}")
            fs.delete(where, True)


def remembering_scan(stream: DataFrame, memory: Memory, judge: Judge, checkpoint: str, interval: str | None = None):
    """The query that delivers every batch of a stream of events to ``memory``."""
    writer = stream.writeStream.foreachBatch(lambda events, batch: memory.deliver(judge, events, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
