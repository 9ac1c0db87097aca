"""Boolean filters as dictionaries, compiled to Spark columns.

A filter is {"op": "and" | "or", "filters": [...]}, {"op": "not", "filter": ...}, or a
test of a field: eq, ne, gt, gte, lt, lte (value), in (values), exists, and geowithin
(top_left, bottom_right). A field is a column, or a dotted path into a VARIANT column;
arrays on the way are looked into. Logic has two values: a missing field fails every
test but ne.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERED = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


class FilterError(ValueError):
    """The filter is malformed or names a field that the table lacks."""


def fields(condition: dict) -> set[str]:
    """All fields that a filter names."""
    op = condition["op"]
    if op in ("and", "or"):
        return set().union(*(fields(c) for c in condition["filters"]))
    return fields(condition["filter"]) if op == "not" else {condition["field"]}


def validate(condition: dict, names: Iterable[str]) -> None:
    unknown = {f.split(".")[0] for f in fields(condition)} - set(names)
    if unknown:
        raise FilterError(f"unknown fields {sorted(unknown)}")


def _is_array(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def path_values(root: Column, path: list[str]) -> Column:
    """All values at a path in a VARIANT, as an array: arrays before its last part count with each of their elements."""
    def below(part: str):
        def inside(v: Column) -> Column:
            elements = F.when(_is_array(v), v.cast("array<variant>")).otherwise(F.array(v))
            return F.transform(elements, lambda e: F.try_variant_get(e, f"$.{part}", "variant"))

        return inside

    values = F.array(F.try_variant_get(root, f"$.{path[0]}", "variant"))
    for part in path[1:]:
        values = F.flatten(F.transform(F.filter(values, lambda v: v.isNotNull()), below(part)))
    return F.filter(values, lambda v: v.isNotNull())


def _variant_equal(v: Column, value) -> Column:
    kind = F.schema_of_variant(v)
    if value is None:
        return kind == "VOID"
    if isinstance(value, datetime):
        return F.coalesce(F.try_variant_get(v, "$", "timestamp") == F.lit(value), F.lit(False))
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(value))
    if isinstance(value, int):
        return (kind == "BIGINT") & (F.try_variant_get(v, "$", "bigint") == F.lit(value))
    if isinstance(value, float):
        return (kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")) & (F.try_variant_get(v, "$", "double") == F.lit(value))
    return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(value))


def _variant_ordered(v: Column, op: str, value) -> Column:
    kind = F.schema_of_variant(v)
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & ORDERED[op](F.try_variant_get(v, "$", "boolean"), F.lit(value))
    if isinstance(value, datetime):
        return ORDERED[op](F.try_variant_get(v, "$", "timestamp"), F.lit(value))
    if isinstance(value, (int, float)):
        numeric = kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT")
        return numeric & ORDERED[op](F.try_variant_get(v, "$", "double"), F.lit(float(value)))
    return (kind == "STRING") & ORDERED[op](F.try_variant_get(v, "$", "string"), F.lit(value))


def _within(lat: Column, lon: Column, condition: dict) -> Column:
    a, b = condition["top_left"], condition["bottom_right"]
    return lat.between(b["lat"], a["lat"]) & lon.between(a["lon"], b["lon"])


def _test(condition: dict, kinds: dict[str, str]) -> Column:
    op, field = condition["op"], condition["field"]
    root, *path = field.split(".")
    if path and kinds[root] == "variant":
        if op == "exists":
            return F.size(path_values(F.col(root), path)) > 0

        def test(v: Column) -> Column:
            if op == "eq":
                return _variant_equal(v, condition["value"])
            if op == "in":
                return reduce(lambda a, b: a | b, [_variant_equal(v, x) for x in condition["values"]], F.lit(False))
            if op == "geowithin":
                return _within(F.try_variant_get(v, "$.lat", "double"), F.try_variant_get(v, "$.lon", "double"), condition)
            return _variant_ordered(v, op, condition["value"])

        if len(path) == 1:
            return test(F.try_variant_get(F.col(root), f"$.{path[0]}", "variant"))
        return F.exists(path_values(F.col(root), path), lambda v: F.coalesce(test(v), F.lit(False)))
    column = F.col(field)
    if op == "exists":
        return column.isNotNull()
    if op == "eq":
        return column == F.lit(condition["value"])
    if op == "in":
        return column.isin(list(condition["values"])) if condition["values"] else F.lit(False)
    if op == "geowithin":
        return _within(column["lat"], column["lon"], condition)
    return ORDERED[op](column, F.lit(condition["value"]))


def compile_filter(condition: dict, table: DataFrame) -> Column:
    """The filter as a condition on the table's rows that is never null."""
    validate(condition, table.columns)
    kinds = dict(table.dtypes)

    def build(c: dict) -> Column:
        op = c["op"]
        if op == "and":
            return reduce(lambda a, b: a & b, map(build, c["filters"]), F.lit(True))
        if op == "or":
            return reduce(lambda a, b: a | b, map(build, c["filters"]), F.lit(False))
        if op == "not":
            return ~build(c["filter"])
        if op == "ne":
            return ~F.coalesce(_test({**c, "op": "eq"}, kinds), F.lit(False))
        if op not in ("eq", "in", "exists", "geowithin", *ORDERED):
            raise FilterError(f"unknown operation {op!r}")
        return F.coalesce(_test(c, kinds), F.lit(False))

    return build(condition)
