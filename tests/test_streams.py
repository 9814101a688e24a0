import datetime
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspan.operators import jobs as batch_jobs
from larkspan.streaming import jobs, records, runs


@pytest.fixture(scope="module")
def events(data):
    rows = pd.read_parquet(f"{data}/sf0.001/events.parquet").sort_values(["ts", "event_id"])
    return rows


def in_files(spark, frame, folder, parts):
    """A function that puts the next part of frame (by time) into the folder, and gives all rows so far."""
    size = -(-len(frame) // parts)

    def put(k):
        part = frame.iloc[k * size : (k + 1) * size]
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(folder)
        return frame.iloc[: (k + 1) * size]

    return put


def test_records_that_expire_equal_the_batch_version(spark, events, tmp_path):
    frame = events.assign(post_id=events.event_id % 40)[["post_id", "ts", "event_id"]]
    folder, out, seconds = f"file://{tmp_path}/in", f"file://{tmp_path}/out", 12 * 3600
    put = in_files(spark, frame, folder, 4)
    sizes = []
    for k in range(4):  # each run goes on from the checkpoint of the one before
        so_far = put(k)
        stream = spark.readStream.schema("post_id bigint, ts timestamp, event_id bigint").parquet(folder)
        progress = runs.run_to_end(records.held(stream, seconds, "post_id", "event_id"), out, f"{tmp_path}/c")
        got = records.living(runs.written(spark, out, "post_id bigint, at bigint, event_id bigint, held boolean"), "post_id")
        now = str(so_far.ts.max())
        want = batch_jobs.fresh(spark.createDataFrame(so_far).withColumn("ts", F.col("ts").cast("timestamp_ntz")), now, seconds, ["post_id"])
        assert sorted((r.post_id, r.event_id) for r in got.collect()) == sorted((r.post_id, r.event_id) for r in want.collect())
        sizes.append(progress[-1]["stateOperators"][0]["numRowsTotal"])
        assert got.count() < so_far.post_id.nunique() or k == 0
    # The record, its timer and the timer's index: state follows what lives, not what has been.
    assert max(sizes) <= 4 * 40


def test_state_forgets_by_the_clock(spark, tmp_path):
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"

    def run(keys):
        spark.createDataFrame([(k,) for k in keys], "k bigint").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("k bigint").parquet(folder)
        progress = runs.run_to_end(records.seen_lately(stream, 15, "k"), out, f"{tmp_path}/c", by_clock=True)
        last = runs.last_of(runs.written(spark, out, "k bigint, n bigint, again boolean"), "k")
        return {r.k: (r.n, r.again) for r in last.collect()}, progress

    assert run([1, 1, 2])[0] == {1: (2, False), 2: (1, False)}
    assert run([1])[0][1] == (3, True)
    time.sleep(16)
    found, _ = run([1, 3])
    assert found[1] == (1, False) and found[3] == (1, False)  # key 1 was forgotten in between
    _, progress = run([3])
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 6  # key 2 is gone


def plain_jobs(messages, stall, keep, now):
    """Jobs by a loop over all messages, one job at a time: status, progress, total, updated, failed, lost of those not forgotten."""
    out = {}
    for job, rows in messages.groupby("job"):
        state = None
        for m in rows.sort_values(["ts", "seq"]).itertuples():
            if state and not state["end"] and state["last"] is not None and stall is not None and m.ts > state["last"] + stall:
                state.update(status="stalled", end=state["last"] + stall)
            if state and state["end"] and keep is not None and m.ts > state["end"] + keep:
                state = None
            state = state or {"status": "pending", "end": None, "last": None, "progress": 0, "total": 0}
            if state["end"]:
                continue
            if m.kind in ("done", "failed", "cancel"):
                state.update(status="cancelled" if m.kind == "cancel" else m.kind, end=m.ts)
                continue
            state["last"] = m.ts
            if m.kind == "start" and state["status"] == "pending":
                state["status"] = "running"
            if m.kind == "set":
                state["progress"] = m.n
            if m.kind == "add":
                state["progress"] += m.n
            if m.kind == "total":
                state["total"] = m.n
        if stall is not None and not state["end"] and state["last"] is not None and now > state["last"] + stall:
            state.update(status="stalled", end=state["last"] + stall)
        if not (state["end"] and keep is not None and now > state["end"] + keep):
            out[job] = (state["status"], state["progress"], state["total"])
    return out


KINDS = ["start", "total", "add", "set", "add", "done", "add", "cancel", "start", "failed"]


@pytest.mark.parametrize("stall,keep,parts", [(None, None, 1), (None, None, 3), (45, 60, 1), (45, 60, 4)])
def test_job_machine_equals_plain_loops_however_cut(spark, events, tmp_path, stall, keep, parts):
    """With jobs that come back after they were forgotten, and a restart after each part."""
    log = events.assign(seq=events.event_id, job=events.user_id % 12, n=events.event_id % 50, kind=[KINDS[(7 * e + u) % 10] for e, u in zip(events.event_id, events.user_id, strict=True)])[["job", "seq", "ts", "kind", "n"]].reset_index(drop=True)
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    put = in_files(spark, log, folder, parts)
    minutes = lambda m: None if m is None else pd.Timedelta(minutes=m)
    for k in range(parts):
        so_far = put(k)
        stream = spark.readStream.schema("job bigint, seq bigint, ts timestamp, kind string, n bigint").parquet(folder)
        runs.run_to_end(jobs.job_updates(stream, stall, keep, order=("at", "seq")), out, f"{tmp_path}/c")
        board = jobs.job_board(runs.written(spark, out, jobs.UPDATE)).collect()
        assert {r.job: (r.status, r.progress, r.total) for r in board} == plain_jobs(so_far, minutes(stall), minutes(keep), so_far.ts.max()), k


@pytest.mark.parametrize("broken", [None, "stage_votes_log", "stage_votes", "stage_scores", "manifest", "swapped"])
def test_a_log_of_votes_that_is_merged_now_and_then(spark, tmp_path, broken):
    from larkspan.operators import votes as batch_votes
    from larkspan.sources.snapshots import Snapshots
    from larkspan.streaming import votes as stream_votes

    class Breaks(Snapshots):
        armed = False

        def stage(self, table, rows):
            out = super().stage(table, rows)
            if self.armed and broken == f"stage_{table}":
                raise OSError("gone")
            return out

        def swap(self, changes, replace=False):
            if self.armed and broken == "manifest":
                raise OSError("gone")
            super().swap(changes, replace)
            if self.armed and broken == "swapped":
                raise OSError("gone")

    rng = random.Random(3)
    schema = "seq long, entity long, user_id long, vote int"
    log = [(i, rng.randint(1, 30), rng.randint(1, 4), rng.choice([-1, 0, 1])) for i in range(150)]
    tables = Breaks(spark, f"file://{tmp_path}/t")
    fold = stream_votes.log_batch(tables, merge_after=3)
    for k in range(5):
        batch = spark.createDataFrame(log[30 * k : 30 * k + 30], schema)
        before = {t: set(tables.current().get(t, {}).values()) for t in ("votes", "scores")}
        tables.armed = k == 2  # the third batch is logged, then merged
        if broken and tables.armed:
            with pytest.raises(OSError, match="gone"):
                fold(batch, k)
            tables.armed = False
        fold(batch, k)
        if k != 2:  # nothing but the batch was written
            assert {t: set(tables.current().get(t, {}).values()) for t in ("votes", "scores")} == before
        so_far = spark.createDataFrame(log[: 30 * k + 30], schema)
        assert sorted(stream_votes.votes_now(tables).collect()) == sorted(batch_votes.latest(so_far).collect())
        assert sorted(stream_votes.scores_now(tables).collect()) == sorted(batch_votes.scores(so_far).collect())
    assert len(tables.current()["votes_log"]) in (2, 3)
    with pytest.raises(Exception, match="a vote is"):
        fold(spark.createDataFrame([(999, 1, 1, 7)], schema), 9)


def test_late_polls_items_and_totals(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = [(1, at(0), "start", None, None, 4), (1, at(1), "item", True, None, None), (1, at(2), "item", False, None, None), (1, at(3), "poll", None, 3, None), (1, at(4), "poll", None, 3, None), (1, at(5), "item", True, None, None),
            (1, at(6), "item", True, None, None), (2, at(0), "start", None, None, 9), (2, at(1), "item", True, None, None), (2, at(15), "item", True, None, None), (3, at(20), "start", None, None, 5)]
    frame = spark.createDataFrame(rows, "job bigint, ts timestamp, kind string, ok boolean, n bigint, total bigint")
    frame.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"file://{tmp_path}/in")
    runs.run_to_end(jobs.job_updates(stream, 10, 30, order=("at", "kind", "n")), f"file://{tmp_path}/out", f"{tmp_path}/c")
    got = {r.job: r for r in jobs.job_board(runs.written(spark, f"file://{tmp_path}/out", jobs.UPDATE)).collect()}
    assert (got[1].status, got[1].updated, got[1].failed, got[1].lost, got[1].current) == ("done", 2, 1, 1, 4)
    assert (got[2].status, got[2].updated, got[2].ended_at) == ("stalled", 1, 1704067200_000000 + 11 * jobs.MINUTE)
    assert got[3].status == "running"
