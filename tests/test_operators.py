import random

import pytest
from pyspark.sql import functions as F

from larkspan.operators import discuss, feed, ingest, jobs, messages, mutate, similarity, stats, tagging, votes

POST = "id long, user_id long, label string, created_at timestamp_ntz, dirty boolean, released boolean, deleted boolean, score int"


def post(i, label="sfw", dirty=False, released=True, deleted=False, user=1):
    return (i, user, label, None, dirty, released, deleted, i)


@pytest.fixture(scope="module")
def posts(spark):
    """60 visible posts with gaps in their ids, and hidden ones of each kind."""
    rows = [post(3 * i, "sfw" if i % 2 else "nsfp") for i in range(1, 61)]
    rows += [post(1000, dirty=True), post(1001, released=False), post(1002, deleted=True), post(1003, "nsfw"), post(1004, "secret")]
    return spark.createDataFrame(rows, POST)


LABELS = ["sfw", "nsfp"]
VISIBLE = [3 * i for i in range(60, 0, -1)]


def ids(df):
    return [r.id for r in df.collect()]


def test_pages(posts):
    assert ids(feed.page(posts, LABELS, 2, 25)) == VISIBLE[25:50] and ids(feed.page(posts, [], 1)) == []
    assert ids(feed.older(posts, LABELS, 90, 7)) == [i for i in VISIBLE if i < 90][:7]
    for limit in (9, 10, 11):  # one fewer, exactly and one more than there are newer ones
        newer = [i for i in VISIBLE if i > 150]
        assert len(newer) == 10
        assert ids(feed.newer(posts, LABELS, 150, limit, "contiguous")) == newer[-limit:]
        kept = newer[-(limit + 1) :][:limit]
        assert ids(feed.newer(posts, LABELS, 150, limit)) == kept
    assert feed.has_more(posts, LABELS, 150, 9, "newer").first().has_more and not feed.has_more(posts, LABELS, 150, 10, "newer").first().has_more
    assert ids(feed.around(posts, LABELS, 90, 3, "contiguous")) == [99, 96, 93, 90, 87, 84, 81]
    assert feed.position(posts, LABELS, 1000).first().position == 0 and feed.position(posts, LABELS, 30).first()[:] == (50, 2)


@pytest.fixture()
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranks(posts, many_parts):
    got = {r.id: r.position for r in feed.ranked(posts.where("id < 1000").select("id")).collect()}
    assert got == {x: i for i, x in enumerate(VISIBLE)}
    near = {r.id: (r.newer_id, r.older_id) for r in feed.neighbours(posts, LABELS).collect()}
    assert near == {x: (([None, *VISIBLE][i]), [*VISIBLE[1:], None][i]) for i, x in enumerate(VISIBLE)}
    rows = {(r.row, r.kind): r.ids for r in feed.grid_rows(posts, LABELS, 7, 90).collect()}
    assert rows[(0, "posts")] == VISIBLE[:7] and rows[(VISIBLE.index(90) // 7, "expanded")] == [90] and len(rows) == 10


@pytest.mark.parametrize("key", ["id", "id * 1000000007", "xxhash64(id)"])
def test_ranks_of_dense_sparse_and_hashed_keys(spark, many_parts, key):
    rows = spark.range(5000).selectExpr("id", f"{key} AS k", "'x' AS _other")
    ranked = feed.ranked(rows, key="k", descending=False)
    assert "Window" not in ranked._jdf.queryExecution().executedPlan().toString() and ranked.columns == ["id", "k", "_other", "position"]
    got = [(r.position, r.k) for r in ranked.collect()]
    assert [k for _, k in sorted(got)] == sorted(k for _, k in got) and sorted(p for p, _ in got) == list(range(5000))
    _, parts = feed.sorted_parts(rows.withColumn("_key", F.col("k")), F.asc("_key"))
    assert len(parts) == 4 and max(p["n"] for p in parts) < 3 * 5000 / 4
    old = spark.createDataFrame([(7, "a")], "id bigint, name string")
    made = mutate.inserted(old, rows.select(F.lit("n").alias("name"), "k"), "k")
    assert "Window" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in made.collect()) == list(range(7, 5008))
    assert feed.ranked(rows.limit(0), key="k").count() == 0


def test_rank_directory(spark, tmp_path):
    from larkspan.operators.ranks import RankDirectory

    rng = random.Random(3)
    held = {rng.randrange(1 << 50) for _ in range(3000)}
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "id bigint")
    directory = RankDirectory(spark, f"file://{tmp_path}/d", most=400)
    directory.build(frame(held))
    for _ in range(3):
        every = sorted(held, reverse=True)
        for k in [*rng.sample(every, 3), every[0], every[-1], 0, 1 << 51]:
            place = directory.position(k)
            assert place.first().position == sum(x > k for x in held)
            assert len(place.inputFiles()) == 1 if every[-1] <= k <= every[0] else True
        for number in (1, 17, 40, 10_000):
            page = directory.page(number)
            assert [r.id for r in page.collect()] == every[(number - 1) * 50 : number * 50]
            assert len({f.rsplit("/", 2)[1] for f in page.inputFiles()}) <= 2
        before = directory.parts()
        new, gone = {rng.randrange(every[-1], every[-1] + (1 << 40)) for _ in range(900)}, set(rng.sample(every[-200:], 20))
        directory.change(frame(new - held), frame(gone))
        held = (held | new) - gone
        assert len(before.keys() & directory.parts().keys()) >= 4  # ranges without a change stay as they are
        assert max(n for _, n in directory.parts().values()) <= 400
    assert directory.total() == len(held)
    new = {rng.randrange(1 << 50) for _ in range(9000)} - held  # every range grows beyond its size
    directory.change(frame(new), frame([]))
    held |= new
    every = sorted(held, reverse=True)
    assert directory.total() == len(held) and max(n for _, n in directory.parts().values()) <= 400
    assert all(directory.position(k).first().position == sum(x > k for x in held) for k in rng.sample(every, 3))
    assert [r.id for r in directory.page(100).collect()] == every[4950:5000]
    directory.change(frame([]), frame(held - {every[7]}))
    assert directory.total() == 1 and [r.id for r in directory.page(1).collect()] == [every[7]]
    empty = RankDirectory(spark, f"file://{tmp_path}/e")
    empty.build(frame([]))
    assert empty.total() == 0 and empty.page(1).count() == 0 and empty.position(5).first().position == 0
    empty.change(frame([5, 9]), frame([]))
    assert [r.id for r in empty.page(1).collect()] == [9, 5]


def test_votes_by_brute_force(spark):
    rng = random.Random(0)
    log = [(i, rng.randint(1, 5), rng.randint(1, 4), rng.choice([-1, 0, 1])) for i in range(200)]
    df = spark.createDataFrame(log, "seq long, entity long, user_id long, vote int").repartition(4)
    state = {}
    for _, e, u, v in log:
        state[e, u] = v
    assert {(r.entity, r.user_id): r.vote for r in votes.latest(df).collect()} == {k: v for k, v in state.items() if v}
    assert {r.entity: r.score for r in votes.scores(df).collect()} == {e: sum(v for (x, _), v in state.items() if x == e) for e in {k[0] for k in state}}
    assert votes.deltas(df).agg(F.sum("delta")).first()[0] == sum(state.values())
    with pytest.raises(Exception, match="a vote is"):
        votes.latest(df.withColumn("vote", F.lit(2))).collect()
    own = feed.with_vote(spark.createDataFrame([(1,), (99,)], "id long"), votes.latest(df), 1)
    assert {r.id: r.vote for r in own.collect()} == {1: state.get((1, 1), 0), 99: 0}


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    from larkspan.sources.snapshots import Snapshots
    from larkspan.streaming.votes import flush

    rng = random.Random(1)
    log = [(i, rng.randint(1, 5), rng.randint(1, 4), rng.choice([-1, 0, 1])) for i in range(120)]
    schema = "seq long, entity long, user_id long, vote int"
    tables = Snapshots(spark, f"file://{tmp_path}/tables")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    for k in range(3):  # each time a new query goes on from the checkpoint
        spark.createDataFrame(log[40 * k : 40 * k + 40], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        flush(stream, tables, f"{tmp_path}/checkpoint", None).awaitTermination()
    whole = spark.createDataFrame(log, schema)
    assert sorted(tables.read("votes").select("entity", "user_id", "vote").collect()) == sorted(votes.latest(whole).collect())
    assert {r.entity: r.score for r in tables.read("scores").collect()} == {r.entity: r.score for r in votes.scores(whole).collect()}


SCHEMA = "seq long, entity long, user_id long, vote int"


@pytest.mark.parametrize("step", ["stage_votes", "stage_scores", "manifest", "swapped"])
def test_a_crash_between_steps_loses_nothing(spark, tmp_path, monkeypatch, step):
    from larkspan.sources.snapshots import Snapshots
    from larkspan.streaming.votes import fold_batch

    class Breaks(Snapshots):
        broken = None

        def stage_parts(self, table, rows, parts):
            out = super().stage_parts(table, rows, parts)
            if self.broken == f"stage_{table}":
                raise OSError("gone")
            return out

        def swap(self, changes, replace=False):
            if self.broken == "manifest":
                raise OSError("gone")
            super().swap(changes, replace)
            if self.broken == "swapped":
                raise OSError("gone")

    rng = random.Random(3)
    log = [(i, rng.randint(1, 40), rng.randint(1, 4), rng.choice([-1, 0, 1])) for i in range(90)]
    tables = Breaks(spark, f"file://{tmp_path}/t")
    fold = fold_batch(tables)
    batches = [spark.createDataFrame(log[a : a + 30], SCHEMA) for a in (0, 30, 60)]
    fold(batches[0], 0)
    before = {t: sorted(tables.read(t).collect()) for t in ("votes", "scores")}
    tables.broken = step
    with pytest.raises(OSError, match="gone"):
        fold(batches[1], 1)
    again = Snapshots(spark, f"file://{tmp_path}/t")  # as after a restart
    now = {t: sorted(again.read(t).collect()) for t in ("votes", "scores")}
    assert (now == before) == (step != "swapped")
    sums = {}
    for e, _, v in now["votes"]:
        sums[e] = sums.get(e, 0) + v
    assert all(sums.get(e, 0) == s for e, s in now["scores"])  # both tables are of one moment
    fold = fold_batch(again)
    for k in (1, 1, 2):
        fold(batches[k], k)
    whole = spark.createDataFrame(log, SCHEMA)
    assert sorted(again.read("votes").select("entity", "user_id", "vote").collect()) == sorted(votes.latest(whole).collect())
    assert {r.entity: r.score for r in again.read("scores").collect()} == {r.entity: r.score for r in votes.scores(whole).collect()}


def test_a_batch_writes_the_parts_of_its_entities(spark, tmp_path):
    from larkspan.sources.snapshots import Snapshots
    from larkspan.streaming.votes import fold_batch

    tables = Snapshots(spark, f"file://{tmp_path}/t")
    fold_batch(tables)(spark.createDataFrame([(i, i, 1, 1) for i in range(200)], SCHEMA), 0)
    before = tables.current()
    fold_batch(tables)(spark.createDataFrame([(300, 7, 2, 1), (301, 7, 1, 0)], SCHEMA), 1)
    after = tables.current()
    assert all(sum(before[t][p] != after[t][p] for p in before[t]) == 1 for t in ("votes", "scores"))
    assert [r[:] for r in tables.read("votes").where("entity = 7").select("entity", "user_id", "vote").collect()] == [(7, 2, 1)] and tables.read("scores").count() == 200


def test_a_seeded_stream_counts_each_voter_once(spark, tmp_path):
    from larkspan.streaming.votes import append_to, latest_scores, stream_scores

    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, 5, 1, -1), (2, 5, 2, 1), (3, 6, 1, 0)], SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    seed = spark.createDataFrame([(5, 1, 1), (5, 3, 1), (6, 1, 1), (7, 1, -1)], "entity long, user_id long, vote int")
    stream = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = stream_scores(stream, seed).writeStream.foreachBatch(append_to(f"file://{tmp_path}/out")).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        out.awaitTermination()
    finally:
        spark.conf.unset(conf)
    got = {r.entity: r.score for r in latest_scores(spark.read.parquet(f"file://{tmp_path}/out")).collect()}
    assert got[5] == 1 and got[6] == 0 and got.get(7, -1) == -1


def test_comment_tree(spark):
    rows = [(1, 1, None), (2, 1, 1), (3, 1, 2), (4, 1, 99), (5, 2, None), (6, 1, 1)]
    c = spark.createDataFrame([(*r, "u", "t") for r in rows], "id long, post_id long, parent_id long, user string, content string")
    got = {r.id: (r.depth, r.root_id, r.path) for r in discuss.comment_tree(c).collect()}
    assert got == {1: (0, 1, [1]), 2: (1, 1, [1, 2]), 3: (2, 1, [1, 2, 3]), 4: (0, 4, [4]), 5: (0, 5, [5]), 6: (1, 1, [1, 6])}


def test_long_chains_and_circles(spark):
    rows = [(1, 1, None)] + [(i, 1, i - 1) for i in range(2, 131)] + [(200, 1, 201), (201, 1, 202), (202, 1, 200), (203, 1, 200), (204, 1, 203), (210, 1, 210), (211, 1, 210)]
    random.Random(2).shuffle(rows)
    c = spark.createDataFrame(rows, "id long, post_id long, parent_id long")
    got = {r.id: (r.depth, r.root_id, r.path) for r in discuss.comment_tree(c).collect()}
    assert got == {i: (i - 1, 1, list(range(1, i + 1))) for i in range(1, 131)}


def test_comment_tree_has_no_row_limit(spark):
    rows = [(1, 1, None), (2, 1, 1), (3, 1, 2), (4, 1, 3), (5, 1, 3)]
    c = spark.createDataFrame(rows, "id long, post_id long, parent_id long")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "3")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "2")
    try:
        got = {r.id: (r.depth, r.path) for r in discuss.comment_tree(c).collect()}
        assert discuss.comment_tree(c.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
        spark.conf.unset("spark.sql.cteRecursionLevelLimit")
    assert got == {1: (0, [1]), 2: (1, [1, 2]), 3: (2, [1, 2, 3]), 4: (3, [1, 2, 3, 4]), 5: (3, [1, 2, 3, 5])}


def test_inbox(spark):
    rows = [(1, "private", 1, 2, "a", True, 0), (2, "private", 2, 1, "b", False, 0), (3, "private", 2, 1, "c", False, 0), (4, "system", None, 1, "s", False, 0), (5, "private", 3, 1, "d", True, 1)]
    m = spark.createDataFrame(rows, "id long, kind string, from_id long, to_id long, body string, is_read boolean, t int").withColumn("created_at", F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,t,0)"))
    got = [(r.partner, r.last_body, r.unread) for r in messages.inbox(m, 1).collect()]
    assert got == [(3, "d", 0), (2, "c", 2)]
    assert messages.unread_count(m, 1).first().unread == 3 and messages.unread_count(messages.marked_read(m, 1, partner=2), 1).first().unread == 1


def test_dedup(spark):
    cand = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "n long, url string")
    there = spark.createDataFrame([("a",), ("a",)], "url string")
    assert sorted(r.n for r in ingest.batch_dedup(cand, there, "url").collect()) == [2, 3, 4]
    assert sorted(r.n for r in ingest.sequential_dedup(cand, there, "url", "n").collect()) == [2, 4]
    pages = spark.createDataFrame([(0, 300), (1, 150), (2, 60), (3, 9)], "page long, inserted long")
    assert [r.page for r in ingest.until_enough(pages).orderBy("page").collect()] == [0, 1, 2]
    for values, want in (([], 0), ([42], 42), ([1, 5, 3], 1), ([-5, -1, -10], -10), ([1000 - i for i in range(120)], 881)):
        assert ingest.min_cursor(spark.createDataFrame([(v,) for v in values], "promoted long"), "promoted").first().cursor == want


def test_labels(spark, posts):
    names = spark.createDataFrame([(3, "nsfw"), (3, "secret"), (6, "cat"), (9, "nsfp")], "post_id long, name string")
    got = {r.id: r.label for r in tagging.relabelled(posts, names).collect()}
    assert (got[3], got[6], got[9], got[1004]) == ("secret", "sfw", "nsfp", "sfw")
    got = {r.id: r.label for r in tagging.relabelled(posts, names, "migration").collect()}
    assert (got[3], got[6], got[9], got[1004]) == ("secret", "nsfp", "nsfp", "secret")


def flip(word, n):
    value = word & (2**64 - 1)
    for b in range(n):
        value ^= 1 << b
    return value - 2**64 if value >> 63 else value


def test_hamming_bounds(spark, monkeypatch):
    base = [0x1234, -5, 2**63 - 1, -(2**63)]
    near = {i: [flip(base[0], min(n, 64)), *base[1:]] for i, n in ((2, 0), (3, 1), (4, 49), (5, 50), (6, 51))} | {7: [0, 0, 0, 0]}
    df = spark.createDataFrame([(1, *base)] + [(i, *w) for i, w in near.items()], "id long, " + ", ".join(f"{w} long" for w in similarity.WORDS))
    assert [(r.id, r.distance) for r in similarity.duplicates_of(df, base, exclude=1).collect()] == [(2, 0), (3, 1), (4, 49)]
    brute = sorted(tuple(r) for r in similarity.near_duplicates(df).collect())
    assert brute == sorted(tuple(r) for r in similarity.near_duplicates_banded(df).collect()) and (1, 4, 49) in brute and (1, 5, 50) not in brute
    rng = random.Random(6)
    rows = []
    for i in range(90):
        value = rng.getrandbits(256) if i % 3 == 0 else rows[-1 - i % 3 + 1][1] ^ sum(1 << b for b in set(rng.choices(range(256), k=rng.randint(0, 80))))
        rows.append((i, value))
    signed = lambda w: w - 2**64 if w >> 63 else w
    many = spark.createDataFrame([(i, *[signed(x >> 64 * k & (2**64 - 1)) for k in range(4)]) for i, x in rows], df.schema)
    for near in (1, 17, 33, 50, 64, 65, 120):
        want = sorted((a, b, (x ^ y).bit_count()) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() < near)
        assert sorted(tuple(r) for r in similarity.near_duplicates(many, near).collect()) == want, near
    monkeypatch.setattr(similarity, "BLOCK", 20)
    assert sorted(tuple(r) for r in similarity.near_duplicates(many, 120).collect()) == want
    assert similarity.duplicates_of(df, [0, 0, 0, 0], 1, exclude_zero=True).count() == 0


def test_jobs(spark):
    rows = [("a", 1, "start", 0), ("a", 2, "total", 10), ("a", 3, "add", 2), ("a", 4, "set", 5), ("a", 5, "add", 1), ("b", 1, "cancel", 0), ("b", 2, "start", 0), ("b", 3, "done", 0), ("c", 1, "total", 3), ("d", 1, "start", 0), ("d", 2, "done", 0), ("d", 3, "add", 9)]
    got = {r.job: (r.status, r.progress, r.total) for r in jobs.states(spark.createDataFrame(rows, "job string, seq long, kind string, n long")).collect()}
    assert got == {"a": ("running", 6, 10), "b": ("cancelled", 0, 0), "c": ("pending", 0, 3), "d": ("done", 0, 0)}
    eta = lambda *x: jobs.eta(*map(F.lit, x))
    cases = [(50, 100, 10), (5, 5, 10), (0, 5, 10), (5, 5, 0), (0, 0, 10), (1, 5, 1000), (7, 5, 10)]
    r = spark.range(1).select(jobs.rate(F.lit(50), F.lit(10)), *[eta(*c).alias(f"c{i}") for i, c in enumerate(cases)]).first()
    assert r[:] == (5.0, 10, 0, -1, -1, -1, -1, 0)
    place = [ingest.eta(F.lit(p), F.lit(r), F.lit(44)).alias(f"p{i}") for i, (p, r) in enumerate([(5, 2.0), (0, 2.0), (-1, 2.0), (5, 0.0), (0, 0.0)])]
    assert spark.range(1).select(place).first()[:] == (3, 44, 44, -1, -1)


def test_back_fill(spark):
    def ended(*steps):
        rows = [("j", t, kind, ok, n) for t, kind, ok, n in steps]
        df = spark.createDataFrame(rows, "job string, t int, kind string, ok boolean, n int").withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, t, 0)")).drop("t")
        r = jobs.back_filled(df, F.lit(5)).first()
        return r.updated, r.failed, r.lost, r.current, r.reason

    item, lost = (lambda t, ok=True: (t, "item", ok, None)), (lambda t, n: (t, "poll", None, n))
    assert ended((0, "start", None, None), *[item(t, t != 2) for t in range(1, 6)]) == (4, 1, 0, 5, "complete")
    assert ended((0, "start", None, None), item(1), lost(2, 3), item(3), lost(4, 5)) == (2, 3, 3, 5, "complete")
    assert ended((0, "start", None, None), item(1), lost(2, 1), lost(9, 1), item(14)) == (1, 0, 0, 1, "stalled")
    assert ended(*[item(t) for t in range(1, 9)]) == (5, 0, 0, 5, "complete")


def test_changes(spark, posts):
    users = spark.createDataFrame([(1, "eve", 1), (2, "bob", 10)], "id long, name string, level int")
    assert {r.name: (r.id, r.level) for r in mutate.admin_ensured(users, "eve").collect()} == {"eve": (1, 10), "bob": (2, 10)}
    assert {r.name: (r.id, r.level) for r in mutate.admin_ensured(users, "new").collect()}["new"] == (3, 10)
    inv = spark.createDataFrame([("t", None, None), ("u", 5, None)], "token string, used_by long, used_at timestamp_ntz")
    now = F.expr("timestamp_ntz'2024-01-01'")
    assert [mutate.invitation_used(inv, t, 9, now)[1].first().status for t in ("t", "u", "x")] == ["ok", "used", "not_found"]
    asked = spark.createDataFrame([(1001, 1, ["a", "a"]), (1001, 2, ["a"]), (1000, 1, []), (3, 1, []), (1002, 1, []), (77, 1, [])], "id long, user_id long, tags array<string>")
    got = [(r.status, r.tags) for r in mutate.released(posts, asked).orderBy("id", "user_id").collect()]
    assert got == [("already", []), ("not_found", []), ("unfinished", []), ("ok", ["a"]), ("forbidden", []), ("not_found", [])]
    assert 1000 not in ids(mutate.unfinished_deleted(posts, posts.select("id"))) and mutate.unfinished_deleted(posts, posts.select("id")).count() == 64
    c = spark.createDataFrame([(1, 3, None), (2, 3, 1), (3, 6, 1), (4, 5, None)], "id long, post_id long, parent_id long")
    assert {r.id: r.parent_id for r in mutate.comments_cascaded(c, posts).collect()} == {1: None, 2: 1, 3: 1}
    tags = spark.createDataFrame([(1, "nsfw"), (2, "cat")], "id long, name string")
    links = spark.createDataFrame([(10, 3, 1), (11, 3, 2), (12, 6, 2)], "id long, post_id long, tag_id long")
    tv = spark.createDataFrame([(10, 1, 1), (12, 1, 1)], "entity long, user_id long, vote int")
    after = mutate.tag_deleted(1, tags, links, tv, posts)
    assert ids(after["post_tags"].orderBy("id")) == [11, 12] and after["tag_votes"].count() == 1 and after["posts"].count() == posts.count()
    assert stats.user_profile(posts, 42).count() == 0
