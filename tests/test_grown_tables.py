"""Queries on tables that hold what only larger ones have: large keys, repeated numbers, values next to a threshold."""

import os

import duckdb
import pytest

from larkspan.operators import feed, mutate
from larkspan.plans import registry
from larkspan.sources import scratch
from tests.test_oracles import TABLES, rows_of


@pytest.fixture
def grown(data, tmp_path):
    """A function that makes a folder of tables: the smallest ones, some of them replaced by SQL over all of them. It gives the folder and a connection to its tables."""

    def make(**changes):
        con = duckdb.connect()
        for t in TABLES:
            path = f"{data}/sf0.001/{t}.parquet"
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
            if t not in changes:
                os.symlink(path, tmp_path / f"{t}.parquet")
        for t, sql in changes.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        for t in changes:
            con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        return str(tmp_path), con

    return make


def rows_and_sql(spark, name, folder, con):
    got, want = registry.QUERIES[name](spark, folder), con.sql(registry.ORACLE_SQL[name])
    return rows_of(got.columns, got.collect()), rows_of(list(want.columns), want.fetchall())


def test_times_beyond_what_timestamps_hold(spark, grown):
    folder, con = grown(events="SELECT * FROM events WHERE event_id < 3 UNION ALL SELECT * REPLACE (event_id * 1000000 AS event_id) FROM events WHERE event_id IN (1, 6)")
    got = {r.event_id: r.ago for r in registry.QUERIES["format_time_ago"](spark, folder).collect()}
    assert got == {0: "just now", 1: "just now", 2: "2 min ago", 1_000_000: f"{37 * 10**12 // 31104000} years ago", 6_000_000: f"{37 * 36 * 10**12 // 31104000} years ago"}


def test_a_tag_taken_off_where_link_numbers_repeat(spark, grown):
    """Two links of the post with one number, and one of another post with it: only the votes on the removed link go."""
    extra = "SELECT * REPLACE (7 AS l_orderkey, 3 AS l_linenumber, 1 AS l_partkey) FROM lineitem LIMIT 1"
    folder, con = grown(lineitem=f"SELECT * FROM lineitem WHERE l_orderkey <> 7 UNION ALL ({extra}) UNION ALL ({extra.replace('1 AS l_partkey', '9 AS l_partkey')}) UNION ALL ({extra.replace('7 AS l_orderkey, 3 AS', '6 AS l_orderkey, 13 AS')})")
    got, want = rows_and_sql(spark, "dml_remove_tag", folder, con)
    assert got == want


def test_energy_of_numbers_next_to_a_whole_one(spark, grown):
    """Hundredths whose float lies below them in double precision: 100 * 0.18 is 18 in float."""
    folder, con = grown(embeddings="SELECT vec_id, list_transform(range(64), lambda i: (((i * 7 + vec_id) % 100) / 100)::FLOAT) AS embedding FROM embeddings WHERE vec_id < 20")
    got, want = rows_and_sql(spark, "picture_energy", folder, con)
    assert got == want


def test_pictures_meet_in_blocks_without_keys(spark, data):
    """No join that makes a row of every twentieth pair."""
    found = registry.QUERIES["near_duplicates_banded"](spark, f"{data}/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


@pytest.mark.parametrize("tags,posts", [(4096, 4096), (16, 3)])
def test_links_to_all_tags_of_a_name_are_not_written(spark, grown, monkeypatch, tags, posts):
    """Two hundred tags of four names: what is written meanwhile has fewer rows than the links, and posts keep the links that they have."""
    folder, con = grown(part="SELECT * REPLACE ('n' || p_partkey % 4 AS p_name) FROM part", lineitem="SELECT * FROM lineitem UNION ALL SELECT * REPLACE (l_partkey // 2 AS l_partkey) FROM lineitem")
    if hasattr(mutate, "TAGS_AT_ONCE"):
        monkeypatch.setattr(mutate, "TAGS_AT_ONCE", tags)
        monkeypatch.setattr(mutate, "POSTS_AT_ONCE", posts)
    written = []

    def noted(rows, name):
        out = scratch.settled(rows, name)
        written.append(0 if name == "released" else out.count())  # a row for each request
        return out

    for module in (feed, mutate):
        monkeypatch.setattr(module, "settled", noted, raising=False)
    got, want = rows_and_sql(spark, "dml_release_all", folder, con)
    assert got == want
    new = con.sql(f"SELECT count(*) FROM ({registry.ORACLE_SQL['dml_release_all']}) WHERE tbl = 'new links'").fetchall()[0][0]
    assert new > 1000 and max(written) < new / 2


def test_what_links_say_is_worked_out_before_they_are_made(spark, grown):
    """Two hundred tags of two names: text of a post and a name is put together once, and copied into the links to all tags of the name."""
    folder, con = grown(part="SELECT * REPLACE ('n' || p_partkey % 2 AS p_name) FROM part")
    got, want = rows_and_sql(spark, "dml_release_all", folder, con)
    assert got == want
    plan = registry.QUERIES["dml_release_all"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "new links AS tbl" in line]
    assert made and not any("concat" in line for line in made)


def test_rows_of_a_cascade_are_not_sorted(spark, grown, monkeypatch):
    """Votes of two posts, one of them gone, in many tasks: each hashes its ids, and no task sorts its rows."""
    monkeypatch.setattr(mutate, "ROWS_A_TASK", 100, raising=False)
    folder, con = grown(events="SELECT * REPLACE ('{\"k\": ' || 4 + event_id % 2 || '}' AS props) FROM events")
    got, want = rows_and_sql(spark, "dml_cascade_all", folder, con)
    assert got == want
    plan = registry.QUERIES["dml_cascade_all"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
