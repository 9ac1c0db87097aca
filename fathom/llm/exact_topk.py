"""Exact top-k search by inner product: columnar branch-and-bound.

Vectors are dealt into a grid of query blocks and candidate blocks of fixed sizes.
In a cell the candidates lie in vertical layout (dimension by vector). Scores grow
one block of dimensions at a time; after each, a candidate survives for a query if
its score so far plus a bound on what the remaining dimensions can add (product of
the remaining lengths) still reaches the query's k-th best score. Candidates that
survive for no query, and queries with no candidates, are compacted away.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Vectors in a query block and in a candidate block: what one task holds.
QUERIES, CANDIDATES = 1024, 4096
#: Dimensions that are added at a time, candidates of a cell scored at a time, and queries that share a matrix.
DIMENSIONS, STRIPE, GROUP = 16, 512, 64


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.float64)


def _kind(q: np.ndarray, c: np.ndarray):
    """A float in which every partial sum is exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most >= 2**53:
        return None
    return np.float32 if most < 2**24 else np.float64


def search_block(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best candidates of the block: places in q, candidate ids and integer scores; ties to smaller ids."""
    kind = _kind(q, c)
    if kind is None:  # sums beyond 2^53: exact integers
        scores = q.astype(object) @ c.astype(object).T
        hits = [(i, c_ids[j], int(scores[i, j])) for i in range(len(q)) for j in range(len(c)) if c_ids[j] != q_ids[i]]
        table = pd.DataFrame(hits, columns=["q", "id", "score"]).sort_values(["q", "score", "id"], ascending=[True, False, True]).groupby("q").head(k)
        return table.q.to_numpy(), table.id.to_numpy(np.int64), table.score.to_numpy()
    order = np.argsort(-(c * c).sum(0), kind="stable")  # the heaviest dimensions first
    q, c = q[:, order].astype(kind), c[:, order].astype(kind)
    edges = [*range(0, q.shape[1], DIMENSIONS), q.shape[1]]
    blocks = list(zip(edges[:-1], edges[1:]))
    rest_q = np.stack([np.sqrt((q[:, e:].astype(np.float64) ** 2).sum(1)) for _, e in blocks])
    rest_c = np.stack([np.sqrt((c[:, e:].astype(np.float64) ** 2).sum(1)) for _, e in blocks])
    best_first = np.argsort(-np.sqrt((c.astype(np.float64) ** 2).sum(1)), kind="stable")
    vertical, c_ids, rest_c = np.ascontiguousarray(c[best_first].T), c_ids[best_first], rest_c[:, best_first]
    out_q, out_id, out_s = [], [], []
    for a in range(0, len(q), GROUP):
        group, ids = q[a : a + GROUP], q_ids[a : a + GROUP]
        top_s = np.full((len(group), k), -np.inf)
        top_id = np.full((len(group), k), np.iinfo(np.int64).max)
        for s in range(0, vertical.shape[1], STRIPE):
            columns = np.arange(s, min(s + STRIPE, vertical.shape[1]))
            rows, score = np.arange(len(group)), np.zeros((len(group), len(columns)), kind)
            for b, (x, y) in enumerate(blocks):
                score = score + group[rows, x:y] @ vertical[x:y, columns]
                alive = score + rest_q[b, a + rows][:, None] * rest_c[b, columns][None, :] * (1 + 1e-9) >= top_s[rows, -1][:, None]
                keep_q, keep_c = alive.any(1), alive.any(0)
                if not keep_q.any():
                    rows = rows[:0]
                    break
                if keep_q.mean() < 0.8 or keep_c.mean() < 0.8:
                    rows, columns, score = rows[keep_q], columns[keep_c], score[np.ix_(keep_q, keep_c)]
            if not len(rows):
                continue
            score = np.where(c_ids[columns][None, :] == ids[rows][:, None], -np.inf, score)
            every_s = np.concatenate([top_s[rows], score], axis=1)
            every_id = np.concatenate([top_id[rows], np.broadcast_to(c_ids[columns], score.shape)], axis=1)
            if every_s.shape[1] > 4 * k:  # the k-th best score bounds what has to be sorted
                kth = -np.partition(-every_s, k - 1, axis=1)[:, k - 1]
                most = int((every_s >= kth[:, None]).sum(1).max())
                at = np.argpartition(-every_s, min(most, every_s.shape[1]) - 1, axis=1)[:, :most]
                every_s, every_id = np.take_along_axis(every_s, at, 1), np.take_along_axis(every_id, at, 1)
            at = np.lexsort((every_id, -every_s), axis=1)[:, :k]
            top_s[rows], top_id[rows] = np.take_along_axis(every_s, at, 1), np.take_along_axis(every_id, at, 1)
        found = np.isfinite(top_s)
        out_q.append(a + np.repeat(np.arange(len(group)), found.sum(1)))
        out_id.append(top_id[found])
        out_s.append(top_s[found])
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s)


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of queries(vec_id, vector) the k candidates with the highest integer inner product.

    vector is an array of whole numbers (as double). Vectors of another length than the query's
    are no candidates. Ties go to the smaller vec_id; a candidate with the query's own vec_id is
    the query itself. Rows that repeat a vec_id are queries and candidates of their own. Null
    ids, null and empty vectors, and vectors with null or non-finite components take no part.
    Fewer than k candidates: all of them. Empty inputs give no rows; other columns are not read.
    """
    sound = "vec_id is not null and size(vector) > 0 and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    queries = cut(queries.where(sound).select("vec_id", "vector", F.monotonically_increasing_id().alias("query")), "queries")
    candidates = cut(candidates.where(sound).select("vec_id", "vector", F.monotonically_increasing_id().alias("place")), "candidates")
    rows, columns = max(1, -(-queries.count() // QUERIES)), max(1, -(-candidates.count() // CANDIDATES))
    # each query block meets each candidate block once
    q = queries.withColumn("row", F.pmod(F.xxhash64("query"), F.lit(rows)).cast("int")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    c = candidates.withColumn("col", F.pmod(F.xxhash64("place"), F.lit(columns)).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")]
        lengths = right.vector.map(len) if len(right) else None
        for length, own in left.groupby(left.vector.map(len)) if len(right) else ():
            others = right[lengths == length]
            if len(others):
                ids = own.vec_id.to_numpy()
                at, found, score = search_block(_matrix(own.vector), ids, _matrix(others.vector), others.vec_id.to_numpy(), k)
                out.append(pd.DataFrame({"query": own["query"].to_numpy()[at], "query_id": ids[at], "vec_id": found, "score": score.astype(np.int64)}))
        return pd.concat(out)

    cells = rows * columns
    q, c = q.repartition(min(cells, 100_000), "row", "col"), c.repartition(min(cells, 100_000), "row", "col")
    hits = q.groupBy("row", "col").cogroup(c.groupBy("row", "col")).applyInPandas(cell, "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) with floor(64 x) of each component as a double; vectors that are null, or hold null or non-finite components, are left out."""
    sound = embeddings.where("vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    return sound.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr("transform(embedding, x -> floor(64 * double(x)) * 1D)").alias("vector"))


def op6_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best of every vector for each vec_id divisible by 20."""
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return exact_topk(vectors.where("vec_id % 20 = 0"), vectors, 20)


OP6_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
     s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
           from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
     r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
