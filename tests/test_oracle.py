"""Every query with SQL gives the rows that DuckDB gives for it."""

import os

import duckdb
import pytest

from docloom.plans import queries as core

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = core.oracle_sql()


def compared(spark, query, sql):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df = query(spark, DATA)
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    rows = lambda rs: sorted(repr([float(v) if isinstance(v, float) or hasattr(v, "as_tuple") else v for v in r]) for r in rs)
    return rows(df.select(*cols).collect()), rows(want.select(",".join(cols)).fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    got, want = compared(spark, core.queries()[name], SQL[name])
    assert got == want
    assert got
