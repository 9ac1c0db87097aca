"""Nearest neighbours: exact search, single, filtered, grouped and batched; inverted lists; scalar quantisation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import compile_filter
from ..functions.metrics import cosine, dot, l2_distance, score
from ..plans import selectivity

#: Queries and rows that a task of a batched search holds at a time; more go in further blocks.
QUERY_BLOCK, ROW_BLOCK = 1024, 4096
#: Rows for each inverted list that the centroids are fitted to, and rounds of fitting.
SAMPLE, ROUNDS = 256, 15


def vector_of(table: DataFrame, key: int, id_column: str = "vec_id", vector: str = "embedding") -> list[float]:
    """One row's vector."""
    row = table.where(F.col(id_column) == key).select(vector).first()
    if row is None:
        raise KeyError(f"no row {key}")
    return [float(x) for x in row[0]]


def _check(k: int) -> None:
    if k <= 0:
        raise ValueError("k must be positive")


def scored(table: DataFrame, query: Sequence[float], metric: str, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, score) of the rows whose vectors have the query's length; scores have six decimals."""
    rows = table.where(F.size(vector) == len(query))
    return rows.select(F.col(id_column).alias("id"), F.round(score(metric, F.col(vector), query), 6).alias("score"))


def top(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.desc("score"), "id").limit(k)


def search(table: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", where: dict | None = None, overfetch: int | None = None, **names: str) -> DataFrame:
    """The k best rows (id, score), ties to smaller ids.

    A filter comes before the search. With `overfetch` it comes after: only the best
    overfetch * k rows are tested, so there may be fewer than k results.
    """
    _check(k)
    if where is None:
        return top(scored(table, query, metric, **names), k)
    condition = compile_filter(where, table)
    if overfetch is None:
        return top(scored(table.where(condition), query, metric, **names), k)
    passes = table.where(condition).select(F.col(names.get("id_column", "vec_id")).alias("id"))
    best = top(scored(table, query, metric, **names), overfetch * k)
    return top(passes.join(F.broadcast(best), "id").select("id", "score"), k)


def planned_search(table: DataFrame, query: Sequence[float], k: int, where: dict, metric: str = "cosine", cardinalities: dict[str, int] | None = None) -> DataFrame:
    """search with a filter, which comes first or last by the share of rows that it is estimated to keep.

    Filtering last tests only the best rows; where these leave fewer than k, the filter comes first after all, so the result is exact.
    """
    _check(k)
    if selectivity.strategy(where, cardinalities) == "filter_last":
        most = selectivity.overfetch(selectivity.estimate(where, cardinalities), k)
        held = table.where(F.size("embedding") == len(query)).select(F.col("vec_id").alias("id"), F.round(score(metric, F.col("embedding"), query), 6).alias("score"), compile_filter(where, table).alias("passes"))
        rows = [(r["id"], r["score"]) for r in top(held, most).where("passes").limit(k).collect()]  # k rows
        if len(rows) == k:
            return top(table.sparkSession.createDataFrame(rows, "id long, score double"), k)
    return search(table, query, k, metric, where)


def search_by_group(table: DataFrame, query: Sequence[float], k: int, group: str, metric: str = "cosine") -> DataFrame:
    """The k best rows of each group: (group, rank, id, score)."""
    _check(k)
    rows = table.where(F.size("embedding") == len(query)).select(group, F.col("vec_id").alias("id"), F.round(score(metric, F.col("embedding"), query), 6).alias("score"))
    order = Window.partitionBy(group).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _pair_scores(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    s = q @ c.T
    if metric == "cosine":
        lengths = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)
        s = np.divide(s, lengths, out=np.zeros_like(s), where=lengths > 0)
    elif metric == "l2":
        s = -np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (c * c).sum(1) - 2 * s))
    return np.round(s, 6)


def _met(queries: DataFrame, rows: DataFrame, k: int, metric: str) -> DataFrame:
    """(query_id, rank, id, score) of the k best of rows(id, vector, g) for queries(query_id, vector, g), where g and the vectors' lengths are equal.

    Both sides are hashed into blocks of fixed sizes; within a g each query block meets each
    block of rows in one cell by a shuffle, and a ranking over k rows a cell and query remains.
    """
    queries, rows = (x.where("vector is not null and g is not null").withColumn("dim", F.size("vector")) for x in (queries, rows))
    many = lambda x, block, name: x.groupBy("g", "dim").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias(name))
    blocks = F.broadcast(many(queries, QUERY_BLOCK, "n_row").join(many(rows, ROW_BLOCK, "n_col"), ["g", "dim"]))  # one row a group
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.join(blocks, ["g", "dim"]).withColumn("row", F.pmod(F.xxhash64("query_id"), "n_row").cast("int")).withColumn("col", every("n_col"))
    c = rows.join(blocks, ["g", "dim"]).withColumn("col", F.pmod(F.xxhash64("id"), "n_col").cast("int")).withColumn("row", every("n_row"))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        asked, keys = left.query_id.to_numpy(), right.id.to_numpy()
        x, y = np.stack(left.vector.to_numpy()).astype(np.float64), np.stack(right.vector.to_numpy()).astype(np.float64)
        out = []
        for start in range(0, len(x), 64):
            s = _pair_scores(x[start : start + 64], y, metric)
            for i, own in enumerate(s):
                at = np.arange(len(keys))
                if len(keys) > k:  # equal scores at the k-th place stay until they are ordered by id
                    at = np.flatnonzero(~(own < np.partition(own, len(keys) - k)[len(keys) - k]))
                at = at[np.lexsort((keys[at], -own[at]))[:k]]
                out.append((np.full(len(at), asked[start + i]), keys[at], own[at]))
        return pd.DataFrame({n: np.concatenate(v) for n, v in zip(("query_id", "id", "score"), zip(*out))})

    cells = ("g", "dim", "row", "col")
    hits = q.select(*cells, "query_id", "vector").groupBy(*cells).cogroup(c.select(*cells, "id", "vector").groupBy(*cells)).applyInPandas(cell, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def batch_search(table: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", group: str | None = None) -> DataFrame:
    """(query_id, rank, id, score) of the k best rows of table for each row of queries (both vec_id, embedding, and `group`).

    With `group`, a query sees only rows of its own group. Neither side is collected; there
    may be any number of queries.
    """
    _check(k)
    own = lambda x, name: x.select(F.col("vec_id").cast("long").alias(name), F.col("embedding").alias("vector"), (F.col(group).cast("long") if group else F.lit(0).cast("long")).alias("g"))
    return _met(own(queries, "query_id"), own(table, "id"), k, metric)


def batch_search_where(table: DataFrame, queries: DataFrame, k: int, filters: Sequence[dict | None], metric: str = "cosine", overfetch: bool = False) -> DataFrame:
    """batch_search with a filter for each query: queries(vec_id, embedding, filter), `filter` being a place in `filters` (None there: all rows).

    A row goes only to the queries whose filter it passes. With `overfetch` each query's best
    max(4 k, k + 50) rows are tested instead, so there may be fewer than k results.
    """
    _check(k)
    conditions = [F.lit(True) if f is None else compile_filter(f, table) for f in filters]
    passed = F.explode(F.filter(F.array(*(F.when(c, F.lit(i).cast("long")) for i, c in enumerate(conditions))), lambda g: g.isNotNull()))
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("vector"), F.col("filter").cast("long").alias("g"))
    if not overfetch:
        return _met(asked, table.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"), passed.alias("g")), k, metric)
    best = batch_search(table, queries, max(4 * k, k + 50), metric).drop("rank").join(asked.select("query_id", "g"), "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    kept = best.join(table.select(F.col("vec_id").cast("long").alias("id"), passed.alias("g")), ["id", "g"])
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


# --- inverted lists ----------------------------------------------------------


def centroids(table: DataFrame, n: int) -> list[list[float]]:
    """The first n vectors by id."""
    return [[float(x) for x in r[0]] for r in table.orderBy("vec_id").limit(n).select("embedding").collect()]


def assign(table: DataFrame, centers: list[list[float]], metric: str = "l2") -> DataFrame:
    """table with centroid: the number of the best one, of equal ones the last. Scores have six decimals."""
    best = F.greatest(*(F.struct(F.round(score(metric, F.col("embedding"), c), 6).alias("s"), F.lit(i).alias("i")) for i, c in enumerate(centers))) if len(centers) > 1 else F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i"))
    return table.withColumn("centroid", best["i"])


def probe(assigned: DataFrame, centers: list[list[float]], query: Sequence[float], k: int, nprobe: int, metric: str = "l2") -> DataFrame:
    """Searches the lists of the nprobe centroids that are best for the query; `centroid` may be a partition column."""
    q = np.asarray(query)
    c = np.asarray(centers)
    s = -np.linalg.norm(c - q, axis=1) if metric == "l2" else c @ q / (np.linalg.norm(c, axis=1) * np.linalg.norm(q) if metric == "cosine" else 1)
    lists = np.lexsort((np.arange(len(c)), -s))[:nprobe].tolist()
    return search(assigned.where(F.col("centroid").isin(lists)), query, k, metric)


def fit_centroids(table: DataFrame, n: int) -> list[list[float]]:
    """n centroids at most, by k-means on the n * SAMPLE vectors whose ids hash lowest; further rows are assigned, not fitted."""
    rows = table.where("vec_id is not null and embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(n * SAMPLE).select("embedding").collect()  # a bounded sample
    if not rows:
        return []
    x = np.array([r[0] for r in rows], np.float64)
    c = np.unique(x, axis=0)
    c = c[np.random.default_rng(0).permutation(len(c))[:n]]
    for _ in range(ROUNDS):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
    return c.tolist()


def ivf_search(table: DataFrame, queries: DataFrame, centers: list[list[float]], k: int, nprobe: int) -> DataFrame:
    """(query_id, rank, id, score) by l2: for each row of queries(vec_id, embedding) the k best in the lists of its nprobe nearest centroids.

    Every row of table is in one list. Approximate: neighbours in other lists are missed;
    with nprobe = len(centers) none is.
    """
    _check(k)
    if not centers:
        return _met(*(table.select(F.col("vec_id").alias(n), F.col("embedding").alias("vector"), F.lit(0).alias("g")) for n in ("query_id", "id")), k, "l2")
    known = np.array(centers)

    def nearest(n: int):
        @F.pandas_udf("array<int>")
        def lists(vectors: pd.Series) -> pd.Series:
            x = np.stack(vectors.to_numpy()).astype(np.float64)
            return pd.Series(list(np.argsort((known * known).sum(1) - 2 * x @ known.T, axis=1, kind="stable")[:, :n].astype(np.int32)))

        return lists

    sound = lambda x: x.where(F.size("embedding") == known.shape[1])
    probed = sound(queries).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("vector"), F.explode(nearest(nprobe)("embedding")).alias("g"))
    listed = sound(table).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"), nearest(1)("embedding")[0].alias("g"))
    return _met(probed, listed, k, "l2")


# --- scalar quantisation -----------------------------------------------------


def train_quantizer(table: DataFrame) -> DataFrame:
    """(pos, low, high): the range of each dimension over all vectors."""
    return table.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.min(F.col("x").cast("double")).alias("low"), F.max(F.col("x").cast("double")).alias("high"))


def quantize(table: DataFrame, ranges: DataFrame, bits: int = 8) -> DataFrame:
    """table with code (array<int>) and decoded (array<double>); ranges are one row a dimension."""
    if not 1 <= bits <= 8:
        raise ValueError("bits must lie between 1 and 8")
    top_code = (1 << bits) - 1
    known = {r["pos"]: (r["low"], r["high"]) for r in ranges.collect()}  # one row a dimension
    low = F.array(*(F.lit(known[i][0]) for i in range(len(known))))
    step = F.array(*(F.lit((known[i][1] - known[i][0]) / top_code) for i in range(len(known))))

    def encode(x, i):
        part = (x.cast("double") - F.get(low, i)) / F.get(step, i)
        return F.when(F.get(step, i) == 0, F.lit(0)).otherwise(F.round(F.least(F.greatest(part, F.lit(0.0)), F.lit(float(top_code))))).cast("int")

    coded = table.withColumn("code", F.transform("embedding", encode))
    return coded.withColumn("decoded", F.transform("code", lambda c, i: F.get(low, i) + F.get(step, i) * c))


__all__ = ["assign", "batch_search", "batch_search_where", "centroids", "cosine", "dot", "fit_centroids", "ivf_search", "l2_distance", "probe", "quantize", "search", "search_by_group", "train_quantizer", "vector_of"]
