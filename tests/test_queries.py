"""Every query with SQL returns the rows that DuckDB does."""

import math

import duckdb
import pytest

from fathom import queries as retrieval

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(None if r[i] is None or (isinstance(r[i], float) and math.isnan(r[i])) else r[i] for i in order) for r in rows]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(retrieval.oracle_sql()))
def test_query(spark, db, name):
    ours = retrieval.queries()[name](spark, SF)
    found = db.execute(retrieval.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(ours.columns) == sorted(columns)
    a, b = canonical(ours.collect(), ours.columns), canonical(found.fetchall(), columns)
    assert len(a) == len(b)
    assert a == b
