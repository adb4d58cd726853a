"""Documents, lists, files and streams against their SQL."""

import os

import duckdb
import pytest

from courtlake.plans import documents

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(documents.oracle_sql()))
def test_same_as_sql(spark, con, name):
    df, q = documents.queries()[name](spark, DATA), con.sql(documents.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(q.columns)
    shown = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(repr([shown(r[q.columns.index(c)]) for c in names]) for r in q.fetchall())
    assert sorted(repr([shown(r[c]) for c in names]) for r in df.collect()) == want and want


def test_built_in_court_and_stamps(spark):
    from courtlake.sources.bundles import BUNDLE, DEFAULT_COURT, court_for, parse_pipeline

    games = spark.createDataFrame([(1, "a"), (2, "b")], "game_id long, name string")
    none = spark.createDataFrame([("a", None, [[0.0, 1.0]])], "video string, court_poly array<array<double>>, net array<array<double>>")
    got = {r["game_id"]: r for r in court_for(games, none).collect()}
    assert [tuple(p) for p in got[1]["court"]] == DEFAULT_COURT and got[1]["net"] == [[0.0, 1.0]] and (got[1]["source"], got[2]["source"]) == ("video", "built-in")
    docs = spark.createDataFrame([("x.json",)], "file string").selectExpr("file", f"from_json('{{}}', '{BUNDLE.replace(chr(10), '')}') AS d").select("file", "d.*")
    row = parse_pipeline(docs).first()
    assert row["stage"] is None and not row["training"]
