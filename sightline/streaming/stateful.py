"""Stateful stream processors, one state per source: typed states, timers and time-to-live.

They need a state store with column families: ``store_of`` names it for a session. A processor is given
to ``by_source``. Rows of a batch are taken in order of their time.

* ``Baseline``: the adaptive volume baseline; a list of samples for each weekday and hour, the last
  counter, the first scan and the streak, all of which a source loses that is silent for ``keep_days`` by its
  own times or, where a time-to-live is asked for, by the clock.
* ``Silence``: tells a source that has sent nothing for so long, by the clock of the processing, so also
  when the whole stream has stopped.
* ``Drift``: the fields and types of a day of events, held against the last good day once the watermark
  has passed its end.

Null times are left out; null documents are unknown; an empty batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.history import VERDICT, judge

DAY_MS = 86_400_000
_EPOCH = pd.Timestamp(0)


def store_of(spark: SparkSession) -> None:
    """Let the session keep state in RocksDB, which typed states and timers need; an own choice stays."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def by_source(rows: DataFrame, processor: StatefulProcessor, schema: str, time_mode: str = "None", event_time: str = "") -> DataFrame:
    """``processor`` on every source of a stream, in append mode."""
    store_of(rows.sparkSession)
    grouped = rows.groupBy("source")
    if event_time:
        return grouped.transformWithStateInPandas(processor, schema, "Append", time_mode, eventTimeColumnName=event_time)
    return grouped.transformWithStateInPandas(processor, schema, "Append", time_mode)


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class Baseline(StatefulProcessor):
    """source, scan_ts, bucket, docs, in_downtime -> the verdict of each scan.

    deltas: docs are those since the scan before, and their sum is the counter. expire_s: what nobody
    feeds for so long by the processing's clock goes by itself, which needs that clock as time mode (a query
    with it has no last batch, so a stream that is only drained does without).
    """

    def __init__(self, keep_days: float = 30, deltas: bool = False, expire_s: float | None = None, warmup_s: float = 86400, hysteresis: int = 2, min_samples: int = 4, z: float = 3.0, keep: int = 64):
        self.keep_days, self.deltas, self.expire_s, self.options, self.keep = keep_days, deltas, expire_s, (warmup_s, hysteresis, min_samples, z), max(keep, min_samples)

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = int(self.expire_s * 1000) if self.expire_s else None
        self.counter = handle.getValueState("counter", "first_us long, last_us long, docs double, streak int", ttl)
        self.samples = handle.getMapState("samples", "bucket string", "rates array<double>", ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        pdf = pdf[pdf["scan_ts"].notna()].sort_values("scan_ts")
        if pdf.empty:
            return
        held = self.counter.get() if self.counter.exists() else (None, None, None, 0)
        first, last, docs, streak = held
        buckets: dict[str, list[float]] = {}
        out = []
        for at, bucket, now, down in zip(_micros(pdf["scan_ts"]), pdf["bucket"], pdf["docs"], pdf["in_downtime"]):
            now = None if pd.isna(now) else float(now)
            if last is not None and at - last > self.keep_days * 86_400_000_000:
                first = last = docs = None
                streak, buckets = 0, {}
                self.samples.clear()
            if self.deltas and now is not None:
                now += docs or 0.0
            if first is None:
                first = at
            if bucket not in buckets:
                buckets[bucket] = list(self.samples.getValue((bucket,))[0]) if self.samples.containsKey((bucket,)) else []
            verdict, streak, accepted = judge(at / 1e6, now, None if last is None else last / 1e6, docs, first / 1e6, bool(down), buckets[bucket], streak, *self.options)
            if accepted:
                buckets[bucket] = [*buckets[bucket], verdict[1]][-self.keep :]
            last, docs = at, now
            out.append((key[0], _EPOCH + pd.Timedelta(at, "us"), *verdict))
        for bucket, rates in buckets.items():
            if rates:
                self.samples.updateValue((bucket,), (rates,))
        self.counter.update((first, last, docs, streak))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in VERDICT.split(", ")]).astype({"samples": "Int32", "rate": "Float64", "mean": "Float64", "std": "Float64", "z": "Float64"})

    def close(self) -> None:
        pass


class Silence(StatefulProcessor):
    """source, event_ts -> source, last_event, told_at when nothing has come for max_stale_s seconds of the processing's clock."""

    def __init__(self, max_stale_s: float):
        self.wait_ms = int(max_stale_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_us long, timer_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = pd.concat([r["event_ts"] for r in rows]).dropna()
        if not len(times):
            return
        newest, timer = max(_micros(times)), None
        if self.last.exists():
            before, timer = self.last.get()
            newest = max(newest, before)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
        self.handle.registerTimer(timer)
        self.last.update((newest, timer))
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        last, timer = self.last.get()
        if expiredTimerInfo.getExpiryTimeInMs() != timer:
            return  # an event came since
        self.last.clear()
        at = timerValues.getCurrentProcessingTimeInMs()
        yield pd.DataFrame({"source": [key[0]], "last_event": [_EPOCH + pd.Timedelta(last, "us")], "told_at": [_EPOCH + pd.Timedelta(at, "ms")]})

    def close(self) -> None:
        pass


DRIFT = "source string, day timestamp, status string, added string, removed string, type_changed string"


class Drift(StatefulProcessor):
    """source, event_ts, field, type (of each event's fields) -> the drift of each day once it is over.

    Days are told in their order. A day after one without fields, or the first, is warming.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "day_ms long, field string, type string", "n long")
        self.good = handle.getMapState("good", "field string", "types string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).dropna(subset=["event_ts", "field"])
        mark, day = timerValues.getCurrentWatermarkInMs(), (pdf["event_ts"].astype("datetime64[ms]").astype("int64") // DAY_MS) * DAY_MS
        for (at, field, kind), n in pdf.groupby([day, pdf["field"], pdf["type"]]).size().items():
            if at + DAY_MS <= mark:
                continue  # that day has been told
            slot = (int(at), field, kind)
            self.open.updateValue(slot, ((self.open.getValue(slot)[0] if self.open.containsKey(slot) else 0) + int(n),))
            self.handle.registerTimer(int(at) + DAY_MS)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() - DAY_MS
        now: dict[str, set[str]] = {}
        for day, field, kind in [*self.open.keys()]:
            if day == at:
                now.setdefault(field, set()).add(kind)
                self.open.removeKey((day, field, kind))
        if not now:
            return
        types = {f: "\0".join(sorted(kinds)) for f, kinds in now.items()}
        before = {k[0]: v[0] for k, v in self.good.iterator()}
        for f in before.keys() - types.keys():
            self.good.removeKey((f,))
        for f, kinds in types.items():
            if before.get(f) != kinds:
                self.good.updateValue((f,), (kinds,))
        parts = (types.keys() - before.keys(), before.keys() - types.keys(), {f for f in types.keys() & before.keys() if types[f] != before[f]}) if before else ((), (), ())
        status = "warming" if not before else "drift" if any(parts) else "ok"
        yield pd.DataFrame([(key[0], _EPOCH + pd.Timedelta(at, "ms"), status, *(",".join(sorted(p)) for p in parts))], columns=[c.split()[0] for c in DRIFT.split(", ")])

    def close(self) -> None:
        pass
