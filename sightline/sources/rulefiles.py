"""Rule files as a data source: one object, an array, or an object per line, whichever each file holds.

    rules = normalise_rules(scan_rule_files(spark, "/data/rules").where("problem is null"), "index")

A file is a partition. Filters on ``file`` leave files unread, those on ``rule_id`` and ``type`` are applied
while reading, if spark.sql.python.filterPushdown.enabled is set. A file that can't be read as JSON gives one
row with its ``problem`` and nulls, so that a broken export is told and stops no scan.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructType

from .tables import RULE_SCHEMA

SUFFIXES = (".json", ".jsonl", ".ndjson")
PUSHED = ("file", "rule_id", "type")


class RuleFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _objects(text: str) -> list[dict]:
    """All objects of a file; a first line that is whole JSON with more lines after it makes it one of lines."""
    try:
        whole = json.loads(text)
    except json.JSONDecodeError:
        whole = [json.loads(line) for line in text.splitlines() if line.strip()]
    rows = whole if isinstance(whole, list) else [whole]
    if not all(isinstance(r, dict) for r in rows):
        raise ValueError("a rule is no object")
    return rows


def _fit(value, kind):
    """A JSON value as the column's type; what doesn't fit is null."""
    if isinstance(kind, ArrayType):
        return [str(v) for v in value if v is not None] if isinstance(value, list) else None
    if isinstance(kind, BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(kind, DoubleType):
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    return value if isinstance(value, str) or value is None else json.dumps(value)


class RuleFileReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.fields, self.path = [(f.name, f.dataType) for f in schema.fields], path
        self.only: list[tuple[str, frozenset]] = []

    def _kept(self, row: dict, names: tuple[str, ...]) -> bool:
        return all(row.get(name) in values for name, values in self.only if name in names)

    def partitions(self) -> list[RuleFile]:
        where, root = fs.FileSystem.from_uri(self.path)
        found = where.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(SUFFIXES))
        return [RuleFile(n) for n in names if self._kept({"file": posixpath.relpath(n, root)}, ("file",))]

    def read(self, partition: RuleFile) -> Iterator[tuple]:
        where, root = fs.FileSystem.from_uri(self.path)
        name, problem = posixpath.relpath(partition.path, root), None
        with where.open_input_stream(partition.path) as f:
            data = f.read()
        try:
            rows = _objects(data.decode("utf-8-sig"))
        except ValueError as e:
            rows, problem = [{}], f"{type(e).__name__}: {e}"[:200]
        for row in rows:
            out = {**{c: _fit(row.get(c), kind) for c, kind in self.fields}, "file": name, "problem": problem}
            if self._kept(out, PUSHED):
                yield tuple(out[c] for c, _ in self.fields)


class FilteringReader(RuleFileReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.only.append((f.attribute[0], frozenset(f.value if isinstance(f, In) else [f.value])))
            else:
                yield f


class RuleFiles(DataSource):
    """path: a folder that driver and executors reach, with or without a scheme.

    pushdown: true, to be given filters; Spark refuses such a reader unless the session allows it.
    """

    @classmethod
    def name(cls) -> str:
        return "rule_files"

    def schema(self) -> str:
        return f"{RULE_SCHEMA}, file string, problem string"

    def reader(self, schema: StructType) -> RuleFileReader:
        wanted = self.options.get("pushdown", "false").lower() == "true"
        return (FilteringReader if wanted else RuleFileReader)(schema, self.options["path"])


def scan_rule_files(spark: SparkSession, path: str) -> DataFrame:
    """The rules of all files in a folder, as they are; ``normalise_rules`` takes them from here."""
    spark.dataSource.register(RuleFiles)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("rule_files").option("pushdown", pushdown).load(path)
