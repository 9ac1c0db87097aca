"""Batched and index search over all queries of a table, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom import queries as retrieval
from fathom.operators import knn

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)


def best(ids, x, query, k=10):
    s = np.round(-np.sqrt(((x - query) ** 2).sum(1)), 6)
    return ids[np.lexsort((ids, -s))[:k]].tolist()


def test_all_queries_are_asked(spark, vectors):
    rows = retrieval.queries()["knn_all_l2"](spark, SF).collect()
    assert {r.query_id for r in rows} == {i for i in vectors[0].tolist() if i % 100 == 0}


def test_more_blocks_than_one(spark, vectors, monkeypatch):
    """A query set of any size, as a table: no row is lost or doubled between blocks."""
    monkeypatch.setattr(knn, "QUERY_BLOCK", 64)
    monkeypatch.setattr(knn, "ROW_BLOCK", 150)
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {}
    for r in knn.batch_search(e, e, 10, "l2").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    ids, x = vectors
    assert got == {i: best(ids, x, x[n]) for n, i in enumerate(ids.tolist())}


def test_index_recall(spark, vectors):
    ids, x = vectors
    got = {}
    for r in retrieval.queries()["ivf_search"](spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    asked = [n for n, i in enumerate(ids.tolist()) if i % 100 == 0]
    assert set(got) == {int(ids[n]) for n in asked}
    assert np.mean([len(got[int(ids[n])] & set(best(ids, x, x[n]))) / 10 for n in asked]) >= 0.9


def test_index_holds_every_row(spark, vectors):
    ids, x = vectors
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    centers = knn.fit_centroids(e, 16)
    got = {}
    for r in knn.ivf_search(e, e.where(F.col("vec_id") % 100 == 0), centers, 10, len(centers)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {i: best(ids, x, x[n]) for n, i in enumerate(ids.tolist()) if i % 100 == 0}
