"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from larkspan.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/sf0.001/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    return "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, data, name):
    got = registry.QUERIES[name](spark, f"{data}/sf0.001")
    if name not in registry.ORACLE_SQL:
        assert name in ("picture_hashes", "picture_thumbnails", "picture_facts") and got.count() > 0  # SQL can't resize; see test_pictures
        return
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(list(want.columns), want.fetchall())
