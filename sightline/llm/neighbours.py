"""Approximate nearest neighbours by multi-index hashing.

Vectors are centred, turned by a rotation learned so that signs lose least (principal axes, then
iterative quantisation) and coded by the signs of CODE_BITS coordinates. A code is cut into PARTS
substrings and each is indexed. If two codes differ in at most r bits and the substrings' own radii sum
to r - PARTS + 1, some substring differs in at most its radius, so probing every substring's entries
within it retrieves all codes within r; of these the whole codes are compared, and the floats of those
within r, exactly.

The rotation and r are fitted on a bounded sample of SAMPLE rows, r as the least that finds
TARGET_RECALL of the neighbours there; neighbours in all rows are nearer than in the sample, so recall
on all rows is higher. Where a query retrieves fewer than ``k`` rows of a partition, r grows by WIDER
until it does or all are seen. Every row is indexed: a task indexes the rows of its partition and answers all
queries from them, read in blocks from a shared table, so neither queries nor rows are ever gathered
in one place. It returns the best ``k`` rows of its partition for each query.

Cases: vectors that are null, zero, of another dimension than the commonest (the smallest such on ties), or hold null or
non-finite components take no part, as queries or rows; rows with a query's own id are not its
neighbours; repeated query ids are one query (its smallest vector); null ids take no part; other
columns are ignored; without usable rows the result is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

SAMPLE, SAMPLE_QUERIES, TARGET_RECALL = 4000, 200, 0.97
CODE_BITS, PARTS, TURNS, WIDER = 256, 4, 30, 8
#: Rows of the query table read at a time.
BLOCK = 2048


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


class Rotation:
    """Codes of vectors; fitted on a sample."""

    def __init__(self, sample: np.ndarray, k: int):
        rng = np.random.default_rng(0)
        self.mean, self.dim = sample.mean(0), sample.shape[1]
        centred = sample - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        kept = axes[:, ::-1][:, : min(self.dim, CODE_BITS)]
        columns = []
        while sum(c.shape[1] for c in columns) < CODE_BITS:  # few dimensions are turned more than once
            points, turn = centred @ kept, np.linalg.qr(rng.normal(size=(kept.shape[1],) * 2))[0]
            for _ in range(TURNS):
                u, _, vt = np.linalg.svd(points.T @ np.where(points @ turn > 0, 1.0, -1.0))
                turn = u @ vt
            columns.append(kept @ turn)
        self.matrix = np.concatenate(columns, 1)[:, :CODE_BITS]
        self.radius = self._least_radius(sample, k)

    def parts(self, vectors: np.ndarray) -> np.ndarray:
        bits = np.packbits((vectors - self.mean) @ self.matrix > 0, axis=1)
        return bits.view(f">u{CODE_BITS // PARTS // 8}").astype(np.uint64)

    def _least_radius(self, sample: np.ndarray, k: int) -> int:
        queries = np.arange(min(len(sample), SAMPLE_QUERIES))
        codes = self.parts(sample)
        gaps = sum(np.bitwise_count(part[queries][:, None] ^ part).astype(np.int64) for part in codes.T)
        far = squares(sample[queries], sample)
        far[queries, queries] = np.inf
        nearest = np.argsort(far, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        found = np.sort(np.take_along_axis(gaps, nearest, 1).ravel())
        return int(found[int(np.ceil(TARGET_RECALL * len(found))) - 1]) if found.size else 0


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


class MultiIndex:
    """The substrings of the rows' codes, each with the rows that hold it."""

    def __init__(self, rotation: Rotation, ids: np.ndarray, vectors: np.ndarray):
        self.rotation, self.ids, self.vectors = rotation, ids, vectors
        self.codes, self.tables = rotation.parts(vectors), []
        for part in self.codes.T:
            order = np.argsort(part, kind="stable")
            values, first = np.unique(part[order], return_index=True)
            self.tables.append((values, np.append(first, len(part)), order))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose codes differ from ``code`` in at most ``radius`` bits."""
        found = np.zeros(len(self.ids), bool)
        for i, ((values, first, order), part) in enumerate(zip(self.tables, code)):
            near = (radius + 1 - PARTS + i) // PARTS  # these sum to radius + 1 - PARTS
            at = np.flatnonzero(np.bitwise_count(values ^ part) <= near) if near >= 0 else np.zeros(0, np.int64)
            n = first[at + 1] - first[at]
            found[order[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1, dtype=np.int64) <= radius]

    def search(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        """(query id, row id, distance) of the best k retrieved rows of each query."""
        out = []
        for query, vector, code in zip(ids, vectors, self.rotation.parts(vectors)):
            radius = self.rotation.radius
            while True:
                rows = self.within(code, radius)
                rows = rows[self.ids[rows] != query]
                if len(rows) >= k or radius >= CODE_BITS:
                    break
                radius += WIDER
            if not len(rows):
                continue
            distance = np.sqrt(((self.vectors[rows] - vector) ** 2).sum(1))
            if len(rows) > k:
                near = distance <= np.partition(distance, k - 1)[k - 1]
                rows, distance = rows[near], distance[near]
            best = np.lexsort((self.ids[rows], distance))[:k]
            out.append((np.full(len(best), query), self.ids[rows[best]], distance[best]))
        return [np.concatenate(x) for x in zip(*out)] if out else None


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of each query's k nearest rows found."""
    spark = rows.sparkSession
    rows, queries = (d.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")) for d in (rows, queries))
    schema = "query_id long, vec_id long, score double"
    dims = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == dims.dim)
    # Ids are chosen first, so that no more vectors than these reach the driver; of repeated ids one.
    chosen = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sample = [r.v for r in sorted(rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("v").alias("v")).collect())]
    rotation = Rotation(np.array(sample, np.float64), k)
    folder = store.shared_dir(spark, "queries")
    queries.where(F.size("v") == dims.dim).groupBy("id").agg(F.min("v").alias("v")).write.parquet(folder)

    def run(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        index = MultiIndex(rotation, table.column(0).to_numpy(), _matrix(table.column(1)))
        fs, path = store.filesystem(folder)
        from pyarrow import fs as arrow_fs

        for info in sorted(fs.get_file_info(arrow_fs.FileSelector(path)), key=lambda x: x.path):
            if info.path.endswith(".parquet"):
                with fs.open_input_file(info.path) as f:
                    for block in pq.ParquetFile(f).iter_batches(BLOCK):
                        if found := index.search(block.column(0).to_numpy(), _matrix(block.column(1)), k):
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    found = rows.mapInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
