"""Collections as change logs: each change is a row (seq, op, id, ...), op being insert or delete."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def compact(log: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last change of each key, deletions included. Combined in each task before the shuffle."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("last"))
    return last.select(key, "last.*").select(*log.columns)


def latest(log: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The living rows: each key's last change, where that isn't a deletion."""
    return compact(log, key, seq).where(F.col("op") != "delete")


def insert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """table with the rows whose key it lacks, one of each key."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(*table.columns))


def upsert(table: DataFrame, changes: DataFrame, key: str = "id", seq: str | None = None) -> DataFrame:
    """table with `changes` in place of its rows of the same keys. Of several changes of a key the last by `seq` counts; `seq` itself is left out where table lacks it."""
    if seq is not None:
        changes = compact(changes, key, seq).select(*table.columns)
    return table.join(changes.select(key), key, "left_anti").select(*table.columns).unionByName(changes)


def delete(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti").select(*table.columns)


def append(log: DataFrame, path: str) -> None:
    """Adds changes to a log as new files."""
    log.write.mode("append").parquet(path)


def snapshot(table: DataFrame, path: str) -> None:
    """The whole table as new files; path may lie in any store that Spark can write to."""
    table.write.mode("overwrite").parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a file with one word a line; # starts a comment line."""
    lines = spark.read.text(path).select(F.trim("value").alias("word"))
    return lines.where((F.col("word") != "") & ~F.col("word").startswith("#")).distinct()


def footprint(vector: Column, payload: Column) -> Column:
    """Bytes of a row: four for each component, and the payload's JSON."""
    return 4 * F.size(vector) + F.coalesce(F.octet_length(payload), F.lit(0))


def flatten(payload: Column) -> Column:
    """(key, value) entries of a flat JSON object's fields as text."""
    return F.map_entries(F.from_json(payload, "map<string,string>"))


def _entries(value, path: str) -> Iterator[dict]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _entries(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for v in value:
            yield from _entries(v, path)
    else:
        yield {"path": path, "value": str(value).lower() if isinstance(value, bool) else value}


def flatten_nested(payload: Column) -> Column:
    """(path, value) entries of a JSON text of any depth: dotted paths, each element of an array at the array's own path, numbers as they are written.

    Python, for no expression of a fixed size reaches every depth. Null and broken JSON have no entries, null values stay.
    """

    def entries(text: str | None) -> list[dict]:
        try:
            value = json.loads(text, parse_float=str, parse_int=str, parse_constant=str) if text else {}
        except (ValueError, RecursionError):
            return []
        return list(_entries(value, ""))

    @F.pandas_udf("array<struct<path:string,value:string>>")
    def every(texts: pd.Series) -> pd.Series:
        return texts.map(entries)

    return every(payload)


def valid(table: DataFrame, dimension: int, required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that keep to the schema (an id, vectors of the dimension, required texts), and those that don't."""
    good = F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") == dimension)
    for c in required or []:
        good = good & F.col(c).isNotNull()
    return table.where(good), table.where(~good)
