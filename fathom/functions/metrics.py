"""Similarity of vectors as Spark columns. Scores are oriented so that higher is better."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "cosine", "dot")
#: Literal vectors of no more dimensions are written out term by term; longer ones would outgrow generated code.
WRITTEN_OUT = 16


def _item(v: Column, i: int) -> Column:
    return F.get(v, F.lit(i)).cast("double")


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def _query(q: Column | Sequence[float]) -> Column | Sequence[float]:
    """A literal vector as one array constant, where it is too long to be written out."""
    return q if isinstance(q, Column) or len(q) <= WRITTEN_OUT else F.lit(np.asarray(q, np.float64))


def dot(v: Column, q: Column | Sequence[float]) -> Column:
    """Inner product. With a short literal vector the sum is written out, so that it stays inside generated code."""
    q = _query(q)
    if isinstance(q, Column):
        return F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return _sum([_item(v, i) * F.lit(float(x)) for i, x in enumerate(q)])


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_distance(v: Column, q: Column | Sequence[float]) -> Column:
    q = _query(q)
    if isinstance(q, Column):
        return F.sqrt(F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") - b.cast("double")), F.lit(0.0), lambda s, x: s + x * x))
    parts = [_item(v, i) - F.lit(float(x)) for i, x in enumerate(q)]
    return F.sqrt(_sum([p * p for p in parts]))


def cosine(v: Column, q: Column | Sequence[float]) -> Column:
    """Cosine similarity; 0 where either vector has no length. A literal query's norm is folded into a number."""
    if isinstance(q, Column):
        lengths = norm(v) * norm(q)
    else:
        lengths = norm(v) * F.lit(sum(float(x) ** 2 for x in q) ** 0.5)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(v, q) / lengths)


def score(metric: str, v: Column, q: Column | Sequence[float]) -> Column:
    """The score by a metric: distances are negated."""
    if metric == "l2":
        return -l2_distance(v, q)
    if metric == "cosine":
        return cosine(v, q)
    if metric == "dot":
        return dot(v, q)
    raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")
