"""Folders that the driver and every executor share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


BATCH_ROWS = 1000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder URI under ``spark.checkpoint.dir``.

    Where that setting is missing, only a local master gets a folder of its own: on a cluster a
    machine-local folder would be lost with its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sightline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of BATCH_ROWS rows at most in its session: the JVM and the worker hold whole batches of texts."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to a shared Parquet table and read it back, which cuts the lineage."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a shared folder; runs in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
