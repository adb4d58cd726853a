"""Every registered match query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from courtlake.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = registry.queries()[name](spark, DATA)
    q = con.sql(registry.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(q.columns)
    want = sorted(repr([r[q.columns.index(c)] for c in names]) for r in q.fetchall())
    assert sorted(repr([r[c] for c in names]) for r in df.collect()) == want
