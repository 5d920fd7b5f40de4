"""Result files whose items differ in shape (S2, F13), read as VARIANT.

Later stages add keys to items over time, and runs store one value as a number, a
string, 'n/a' or not at all. One scan takes all files of a grid, whatever shape
their items have: nothing is inferred, and no item fails the read. A typed getter
gives the value, or NULL with the reason (``missing``: absent or JSON null, ``bad``:
there, but not of the type), so bad values can be counted instead of lost.

A file holds a JSON array of items or an object with the array under ``data``; a
file that is no JSON gives one row with a NULL item. A file is read whole by one
task (a JSON array has no record boundaries), so writers bound the items per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_items(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source_file, pos (place in the file), item (VARIANT)."""
    raw = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_name").alias("source_file"), F.try_parse_json("value").alias("v"))
    # an object without ``data`` and a root that is no array have no items
    items = F.coalesce(F.try_variant_get("v", "$.data", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    return raw.select("source_file", F.posexplode_outer(items).alias("pos", "item"))


def getter(item: Column | str, path: str, kind: str) -> tuple[Column, Column]:
    """(value or NULL, state) of a path of the item; state is ok, missing or bad."""
    there = F.try_variant_get(item, path, "variant")
    value = F.try_variant_get(item, path, kind)
    absent = there.isNull() | F.is_variant_null(there)
    state = F.when(absent, "missing").when(value.isNull(), "bad").otherwise("ok")
    return value, state


def kinds(items: DataFrame, item: str = "item") -> DataFrame:
    """field, kind, n: how often each field of the items has a value of each kind
    (BIGINT, DECIMAL, STRING, OBJECT, ARRAY, VOID for JSON null)."""
    fields = items.select(F.explode(F.try_variant_get(item, "$", "map<string,variant>")).alias("field", "value"))
    return fields.groupBy("field", F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"))


def write_items(items: DataFrame, path: str, groups: int, json: str = "json", key: str = "key") -> None:
    """``groups`` files (by hash of ``key``) with the JSON texts of their rows: every
    other one an array, the others an object with the array under ``data``."""
    g = F.pmod(F.xxhash64(key), F.lit(groups))
    files = items.groupBy(g.alias("g")).agg(F.array_join(F.collect_list(json), ",\n").alias("j"))
    wrapped = F.col("g") % 2 == 1
    text = F.concat(F.when(wrapped, '{"data": [').otherwise("["), "j", F.when(wrapped, "]}").otherwise("]"))
    files.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
