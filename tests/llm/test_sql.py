"""The operators that SQL can express, against DuckDB over whole tables."""

import os

import duckdb
import pytest

from larkspan.llm import queries


def plain(v):
    return "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, data, name):
    sf = f"{data}/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got, want = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    place = [list(want.columns).index(c) for c in order]
    assert sorted(tuple(plain(r[c]) for c in order) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in place) for r in want.fetchall())
