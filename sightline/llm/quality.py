"""Quality classifier: a byte-level convolutional network in numpy.

Filters of WIDTH bytes slide over the whole text (one-hot bytes, so a filter is a table of a weight
for each byte at each place). Their outputs are max-pooled over overlapping chunks of 2 * HALF bytes
that start every HALF bytes; the chunks' mean and maximum go through one layer to a probability.

It is fitted with Adam on the driver, on at most FIT_ROWS labelled rows and FIT_BYTES of text chosen by a
hash of their id; texts of over FIT_TEXT bytes are scored but not learned from.
Scoring is a map over partitions: nothing is shuffled.

Cases: null and empty texts score as a chunk of nothing; labels that are null or name no document
are not used; repeated labels count each, of repeated ids one text is learned from; null ids are kept and are not held out; other columns are
ignored; an empty table gives no rows, and without labels every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .tokens import text_slices

FIT_BYTES, FIT_TEXT = 64_000_000, 256_000
FIT_ROWS, EPOCHS, LEAST_STEPS, BATCH, RATE = 4000, 8, 800, 32, 0.01
FILTERS, WIDTH, HALF = 16, 4, 256
#: Bytes convolved at a time.
SPAN = 1 << 18


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, each filled with zeros to whole halves and WIDTH - 1 zeros at least; halves of each)."""
    halves = np.array([-(-(len(t) + WIDTH - 1) // HALF) for t in texts])
    data = b"".join(t.ljust(n * HALF, b"\0") for t, n in zip(texts, halves.tolist()))
    return np.frombuffer(data + b"\0" * (WIDTH - 1), np.uint8), halves


class ByteConvNet:
    def __init__(self):
        rng = np.random.default_rng(0)
        self.p = {
            "table": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), "bias": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), "shift": np.zeros(1, np.float32),
        }
        self.p["table"][:, 0] = 0  # a zero byte is filling

    def _conv(self, data: np.ndarray, n: int) -> np.ndarray:
        out = self.p["table"][0][data[:n]]
        for j in range(1, WIDTH):
            out += self.p["table"][j][data[j : n + j]]
        return out.reshape(-1, HALF, FILTERS)

    def _halves(self, data: np.ndarray) -> np.ndarray:
        n = len(data) - WIDTH + 1
        return np.concatenate([self._conv(data[at : at + SPAN + WIDTH - 1], min(SPAN, n - at)).max(1) for at in range(0, n, SPAN)])

    def _combine(self, pooled: np.ndarray, halves: np.ndarray):
        """(probabilities, and what the gradient needs) from the pooled halves of texts."""
        starts = np.cumsum(halves) - halves
        follows = np.arange(len(pooled)) + 1  # a chunk is a half and the next one of the same text
        follows[starts + halves - 1] -= 1
        second = pooled[follows] > pooled
        chunk = np.where(second, pooled[follows], pooled) + self.p["bias"]
        keep = np.ones(len(pooled), bool)
        keep[(starts + halves - 1)[halves > 1]] = False  # it is part of the chunk before
        at = np.flatnonzero(keep)
        count = np.maximum(halves - 1, 1)
        first = np.cumsum(count) - count
        live = np.maximum(chunk[at], 0)
        mean, top = np.add.reduceat(live, first) / count[:, None], np.maximum.reduceat(live, first)
        features = np.concatenate([mean, top], 1)
        logit = features @ self.p["out"] + self.p["shift"][0]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), (at, follows, second, live, top, features, count)

    def predict(self, texts: list[bytes]) -> np.ndarray:
        data, halves = padded(texts)
        return self._combine(self._halves(data), halves)[0].astype(np.float64)

    def _gradient(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        data, halves = padded(texts)
        conv = self._conv(data, len(data) - WIDTH + 1)
        where = conv.argmax(1)
        probability, (at, follows, second, live, top, features, count) = self._combine(conv.max(1), halves)
        d = ((probability - labels) / len(labels)).astype(np.float32)
        owner = np.repeat(np.arange(len(texts)), count)
        d_mean, d_top = d[:, None] * self.p["out"][:FILTERS] / count[:, None], d[:, None] * self.p["out"][FILTERS:]
        highest = live == top[owner]  # chunks that tie share the gradient
        ties = np.add.reduceat(highest, np.cumsum(count) - count, dtype=np.float32)
        d_live = d_mean[owner] + np.where(highest, (d_top / ties)[owner], 0)
        d_live[live <= 0] = 0
        half = np.where(second[at], follows[at][:, None], at[:, None])
        column = np.broadcast_to(np.arange(FILTERS), half.shape)
        place = half * HALF + where[half, column]
        table = np.stack([np.bincount((data[place + j].astype(np.int64) * FILTERS + column).ravel(), d_live.ravel(), 256 * FILTERS).reshape(256, FILTERS) for j in range(WIDTH)])
        table[:, 0] = 0
        return {"table": table, "bias": d_live.sum(0), "out": d @ features, "shift": d.sum(keepdims=True)}

    def fit(self, texts: list[bytes], labels: np.ndarray) -> "ByteConvNet":
        rng, step = np.random.default_rng(1), 0
        m, v = ({k: np.zeros_like(x, np.float32) for k, x in self.p.items()} for _ in range(2))
        batches = max(1, -(-len(texts) // BATCH))
        epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
        steps = epochs * batches
        for _ in range(epochs):
            for some in np.array_split(rng.permutation(len(texts)), batches):
                step += 1
                for k, g in self._gradient([texts[i] for i in some], labels[some]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g.astype(np.float32)
                    v[k] = 0.999 * v[k] + 0.001 * g.astype(np.float32) ** 2
                    self.p[k] -= RATE * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(key) -> F.Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> ByteConvNet:
    """Fit on at most FIT_ROWS labelled rows that are not held out."""
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).select(F.col(key).alias("id"), F.col(label).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "y").limit(FIT_ROWS).withColumn("nth", F.monotonically_increasing_id())  # so many rows at most are broadcast
    texts = docs.select(key, F.coalesce(text, F.lit("")).alias("t")).where(F.octet_length("t") <= FIT_TEXT)
    one = store.materialise(texts.join(F.broadcast(chosen), F.col(key) == F.col("id")).groupBy("nth").agg(F.first("id").alias("id"), F.first("y").alias("y"), F.min("t").alias("t")), "fit")
    so_far = F.sum(F.octet_length("t")).over(Window.orderBy(F.xxhash64("id"), "nth").rowsBetween(Window.unboundedPreceding, 0))
    rows = one.withColumn("bytes", so_far).where(F.col("bytes") <= FIT_BYTES).select("id", "t", "y").collect()
    rows.sort(key=lambda r: (r.id, r.y, r.t))
    net = ByteConvNet()
    if not rows:
        net.p["out"][:] = 0
        return net
    return net.fit([r.t.encode() for r in rows], np.array([r.y for r in rows]))


def score(docs: DataFrame, net: ByteConvNet, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""

    def run(batches):
        for (ids,), texts in text_slices(batches, [key], text, 8 * SPAN):
            found = net.predict(pc.cast(texts, pa.large_binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(found)], names=["doc_id", "score"])

    return store.small_batches(docs).select(key, text).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, net: ByteConvNet, least: float, text: str = "text") -> DataFrame:
    """The rows whose text scores ``least`` or more, as they are."""

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()), "")
            raw = pc.cast(texts, pa.large_binary())
            good, held, size = [], [], 0
            for t in raw:
                held.append(t.as_py())
                size += len(held[-1])
                if size > 4 * SPAN:
                    good.append(net.predict(held) >= least)
                    held, size = [], 0
            if held:
                good.append(net.predict(held) >= least)
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return store.small_batches(docs).mapInArrow(run, docs.schema)
