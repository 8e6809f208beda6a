"""Every registered query of the climate jobs against its SQL, on the smallest test tables."""

import os

import duckdb
import pytest

from emberline.jobs.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    rel = con.sql(SQL[name])
    cols = sorted(rel.columns)
    assert sorted(df.columns) == cols
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    want = sorted(rel.select(", ".join(f'"{c}"' for c in cols)).fetchall(), key=key)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
