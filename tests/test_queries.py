"""Every registered document query against its SQL, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from sheaf.plans import queries

SF = "/root/testdata/sf0.001"


def plain(x):
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return str(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return str([plain(v) for v in x])
    return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(float(x) if type(x).__name__ == "Decimal" else x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    cur = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted(tuple(map(plain, r)) for r in cur.fetchall())
    assert sorted(tuple(map(plain, r)) for r in got.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
