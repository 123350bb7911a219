"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from symbolgrid.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ran = duck.execute(SQL[name])
    order = [[c[0] for c in ran.description].index(c) for c in columns]
    want = sorted(tuple(str(row[i]) for i in order) for row in ran.fetchall())
    got = sorted(tuple(str(row[c]) for c in columns) for row in df.collect())
    assert got == want
