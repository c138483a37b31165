"""Fields of nested JSON, with their dotted paths and types.

Most events of a source have one of a few shapes. Events are first reduced to one example of each shape, in
one aggregation that combines before it moves; only the examples are taken apart, a level at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

NESTED = ("object", "array")


def variant_type(v: Column) -> Column:
    """object, array, string, boolean, null, long or double; whole numbers beyond 64 bits are long."""
    s = F.schema_of_variant(v)
    whole = (s == "BIGINT") | F.regexp_like(s, F.lit(r"\ADECIMAL\((19|[23]\d),0\)\z"))
    return (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean")
        .when(s == "VOID", "null").when(whole, "long").otherwise("double"))


def json_depth(text: Column) -> Column:
    """How deep objects and arrays of a JSON text are nested."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"]*"', "")
    steps = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    state = lambda at, top: F.struct(at.alias("at"), F.greatest(at, top).alias("top"))
    move = lambda c: F.when(c.isin("{", "["), 1).when(c == "", 0).otherwise(-1)
    return F.reduce(steps, state(F.lit(0), F.lit(0)), lambda a, c: state(a["at"] + move(c), a["top"]), lambda a: a["top"])


def shape_examples(events: DataFrame, json_col: str = "props", keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """keys, json: a text of each shape that a key's events have.

    A shape tells names and types of all fields, but not which of its elements an array mixes, so texts
    with arrays count as shapes of their own, each different one once. Texts that are no JSON object have no shape.
    """
    shape = F.schema_of_variant(F.try_parse_json(json_col))
    shaped = events.select(*keys, F.col(json_col).alias("json"), shape.alias("shape")).where(F.col("shape").startswith("OBJECT"))
    mixed = F.when(F.contains("shape", F.lit("ARRAY<")), F.sha2("json", 256))
    return shaped.groupBy(*keys, "shape", mixed.alias("mixed")).agg(F.min("json").alias("json")).select(*keys, "json")


def _deeper(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, path, type, v: every row, now without its value, and the values in it."""
    found = rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
    name = F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key"))
    kind = variant_type(F.col("value"))
    own = F.struct(F.col("path"), F.col("type"), F.lit(None).cast("variant").alias("v"))
    inner = F.struct(name.alias("path"), kind.alias("type"), F.when(kind.isin(*NESTED), F.col("value")).alias("v"))
    return found.select(*keys, F.inline(F.array_compact(F.array(F.when(F.coalesce("pos", F.lit(0)) == 0, own), F.when(F.col("pos").isNotNull(), inner)))))


def nested_snapshot(events: DataFrame, json_col: str = "props", keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """keys, field, types: sorted types of every field at every depth, each once.

    Names are joined by dots, so a name with a dot is the same as a nested one; elements of an array are
    at its path with ``[]``. Null and invalid texts, those with a name twice and those that are no object have no fields.
    """
    examples = written(shape_examples(events, json_col, keys), "shapes")
    depth = examples.agg(F.max(json_depth(F.col("json"))).alias("d")).first()["d"] or 0  # one number
    value = F.try_parse_json("json")
    rows = examples.select(*keys, F.lit("").alias("path"), F.lit("object").alias("type"), value.alias("v"))
    for _ in range(depth):
        rows = _deeper(rows, keys)
    fields = rows.where("path <> '' or type <> 'object'").select(*keys, F.col("path").alias("field"), "type")
    return fields.groupBy(*keys, "field").agg(F.array_sort(F.collect_set("type")).alias("types"))
