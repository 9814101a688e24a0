"""More registered queries: scans and lookups of single records, changes of several tables, and records with a time to live."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan import schemas
from larkspan.functions import text
from larkspan.operators import discuss, feed, ingest, jobs, lookup, messages, mutate, stats
from larkspan.plans import views as v
from larkspan.plans.registry import LABELS, POST, SEEN, USER, query
from larkspan.sources import feeds

# Stand-ins with all columns of the tables

USERS = "SELECT c_custkey::INT AS id, c_name AS name, 'u' || c_custkey || '@example.org' AS email, 'hash' || c_nationkey AS password, (c_custkey % 11)::INT AS level, TIMESTAMP '2024-01-01' + to_minutes(c_custkey) AS created_at, CASE WHEN c_custkey % 9 = 0 THEN TIMESTAMP '2024-01-01' END AS deleted_at FROM customer"
COMMENTS = "SELECT (conv_id * 100 + turn)::INT AS id, text AS content, 0 AS score, role AS user_name, conv_id::INT AS post_id, TIMESTAMP '2024-01-01' + to_minutes(turn) AS created_at, CASE WHEN turn % 4 = 3 THEN TIMESTAMP '2024-01-01' END AS deleted_at, CASE WHEN turn > 0 THEN (conv_id * 100 + (turn - 1) // 2)::INT END AS parent_id FROM conversations"
INVITATIONS = "SELECT 'inv' || c_custkey AS token, c_nationkey::INT AS created_by, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::INT END AS used_by, TIMESTAMP '2024-01-01' + to_minutes(c_custkey) AS created_at, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-06-01' END AS used_at FROM customer"
SIZED = "SELECT *, CASE WHEN id % 3 = 0 THEN 0 ELSE id % 1900 END AS width, CASE WHEN id % 5 = 0 THEN 0 ELSE id % 1300 END AS height, CASE WHEN id % 4 = 0 THEN 'video' ELSE 'image' END AS content_type FROM posts"


def _at(minutes: F.Column) -> F.Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=minutes.cast("int"))


def users(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = v.table(spark, d, "customer").select(
        key.alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("u"), key.cast("string"), F.lit("@example.org")).alias("email"), F.concat(F.lit("hash"), F.col("c_nationkey").cast("string")).alias("password"),
        (key % 11).alias("level"), _at(key).alias("created_at"), F.when(key % 9 == 0, _at(F.lit(0))).alias("deleted_at"),
    )
    return schemas.conformed(rows, "users")


def comments(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn")
    rows = v.table(spark, d, "conversations").select(
        (F.col("conv_id") * 100 + turn).alias("id"), F.col("text").alias("content"), F.lit(0).alias("score"), F.col("role").alias("user_name"), F.col("conv_id").alias("post_id"),
        _at(turn).alias("created_at"), F.when(turn % 4 == 3, _at(F.lit(0))).alias("deleted_at"), F.when(turn > 0, F.col("conv_id") * 100 + F.floor((turn - 1) / 2)).alias("parent_id"),
    )
    return schemas.conformed(rows, "comments")


def invitations(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    used = key % 3 == 0
    rows = v.table(spark, d, "customer").select(F.concat(F.lit("inv"), key.cast("string")).alias("token"), F.col("c_nationkey").alias("created_by"), F.when(used, key).alias("used_by"), _at(key).alias("created_at"), F.when(used, F.lit("2024-06-01").cast("timestamp_ntz")).alias("used_at"))
    return schemas.conformed(rows, "invitations")


def sized(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("id")
    return v.posts(spark, d).withColumns({"width": F.when(key % 3 == 0, 0).otherwise(key % 1900), "height": F.when(key % 5 == 0, 0).otherwise(key % 1300), "content_type": F.when(key % 4 == 0, "video").otherwise("image")})


# Scans and lookups

@query("live_comments", f"SELECT * FROM ({COMMENTS}) WHERE deleted_at IS NULL")
def live_comments(spark, d):
    return lookup.live(comments(spark, d))


@query("live_users", f"SELECT id, created_at, name, email FROM ({USERS}) WHERE deleted_at IS NULL")
def live_users(spark, d):
    return lookup.users(users(spark, d))


@query("admin_users", f"SELECT id, name, email, level, created_at FROM ({USERS}) WHERE deleted_at IS NULL")
def admin_users(spark, d):
    return lookup.admin_users(users(spark, d))


@query("comment_by_id", f"SELECT * FROM ({COMMENTS}) WHERE id = 200 AND deleted_at IS NULL")
def comment_by_id(spark, d):
    return lookup.by_key(comments(spark, d), "id", 200)


@query("tag_by_id", "SELECT id, name FROM tags WHERE id = 17", "tags")
def tag_by_id(spark, d):
    return lookup.by_key(v.tags(spark, d), "id", 17)


@query("user_by_id", f"SELECT id, created_at, name, email FROM ({USERS}) WHERE id = 7 AND deleted_at IS NULL")
def user_by_id(spark, d):
    return lookup.by_key(users(spark, d), "id", 7, lookup.USER)


@query("user_by_name", f"SELECT * FROM ({USERS}) WHERE name = 'Customer#000000007' AND deleted_at IS NULL")
def user_by_name(spark, d):
    return lookup.user_by_name(users(spark, d), "Customer#000000007")


@query("invitation_by_token", f"SELECT * FROM ({INVITATIONS}) WHERE token = 'inv12'")
def invitation_by_token(spark, d):
    return lookup.by_key(invitations(spark, d), "token", "inv12")


@query("invitations_of_user", f"SELECT * FROM ({INVITATIONS}) WHERE created_by = {USER}")
def invitations_of_user(spark, d):
    return lookup.invitations_of(invitations(spark, d), USER)


@query("comments_of_post", f"SELECT * FROM ({COMMENTS}) WHERE post_id = 2 AND deleted_at IS NULL")
def comments_of_post(spark, d):
    return discuss.of_post(comments(spark, d), 2)


@query("posts_without_size", f"SELECT id, width, height FROM ({SIZED}) WHERE (width = 0 OR height = 0) AND NOT deleted AND NOT dirty", "posts")
def posts_without_size(spark, d):
    return lookup.without_size(sized(spark, d)).select("id", "width", "height")


@query("image_posts", f"SELECT id FROM ({SIZED}) WHERE content_type = 'image' AND NOT deleted AND NOT dirty", "posts")
def image_posts(spark, d):
    return lookup.images(sized(spark, d)).select("id")


# What clients make of loaded rows

@query("notifications_unread", "SELECT CAST(count(*) FILTER (NOT is_read) AS INT) AS unread FROM (SELECT * FROM messages WHERE to_id = 3 AND kind <> 'private' ORDER BY created_at DESC, id DESC LIMIT 20)", "messages")
def notifications_unread(spark, d):
    return messages.unread_of(messages.notifications(v.messages(spark, d), v.posts(spark, d), v.comments(spark, d), USER))


@query("profile_posts", f"SELECT id, score FROM posts WHERE {SEEN} AND user_id = {USER} ORDER BY id DESC LIMIT 33", "posts")
def profile_posts(spark, d):
    return feed.shown(feed.by_user(v.posts(spark, d), USER, LABELS)).select("id", "score")


@query("posts_appended", f"SELECT id, row_number() OVER (ORDER BY id DESC) - 1 AS place FROM (SELECT id FROM posts WHERE {SEEN} ORDER BY id DESC LIMIT 100)", "posts")
def posts_appended(spark, d):
    """Two pages, one put after the other."""
    p = v.posts(spark, d)
    none = spark.createDataFrame([], "id bigint, place bigint")
    return feed.appended(feed.appended(none, feed.page(p, LABELS).select("id")), feed.page(p, LABELS, 2).select("id"))


@query("posts_without_one", f"SELECT id FROM (SELECT id FROM posts WHERE {SEEN} AND id < {POST} ORDER BY id DESC LIMIT 50) WHERE id <> (SELECT max(id) FROM posts WHERE {SEEN} AND id < {POST})", "posts")
def posts_without_one(spark, d):
    page = feed.older(v.posts(spark, d), LABELS, POST).select("id")
    first = page.agg(F.max("id")).first()[0]  # one value
    return feed.without(page, first if first is not None else -1)


@query("admin_stats", """SELECT posts, comments, tags, users, pending_import, total_bytes, breakdown FROM
    (SELECT (SELECT count(*)::INT FROM posts WHERE NOT deleted AND NOT dirty) AS posts, (SELECT count(*)::INT FROM comments) AS comments, (SELECT count(*)::INT FROM tags) AS tags, (SELECT count(*)::INT FROM users) AS users, (SELECT count(*)::INT FROM posts WHERE NOT deleted AND dirty) AS pending_import),
    (SELECT sum(bytes)::BIGINT AS total_bytes, string_agg(label || ':' || bytes || ':' || files, ',' ORDER BY label) AS breakdown FROM (SELECT lang AS label, sum(n_chars)::BIGINT AS bytes, count(*) AS files FROM documents GROUP BY lang))""", "posts", "comments", "tags", "users")
def admin_stats(spark, d):
    disk = feeds.disk_usage(v.table(spark, d, "documents").select(F.col("lang").alias("label"), F.col("n_chars").alias("length")))
    out = stats.admin_stats(stats.admin_counts(v.posts(spark, d), v.comments(spark, d), v.tags(spark, d), v.users(spark, d)), disk)
    entries = F.transform("breakdown", lambda x: F.concat_ws(":", x["label"], x["bytes"].cast("string"), x["files"].cast("string")))
    return out.withColumn("breakdown", F.array_join(entries, ","))


# Records of jobs and queues

@query("back_fill_progress", """WITH m AS (SELECT user_id % 5 AS job, ts, event_id, CASE WHEN event_id % 10 = 0 THEN 'poll' ELSE 'item' END AS kind, event_id % 6 <> 0 AS ok FROM events WHERE event_id % 3 <> 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts, kind, event_id) AS place FROM m),
    k AS (SELECT *, CASE WHEN kind = 'poll' THEN place + place // 10 END AS n FROM n),
    t AS (SELECT *, (n > coalesce(max(n) OVER (PARTITION BY job ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) OR kind = 'item' AS moves FROM k),
    u AS (SELECT *, lag(ts) OVER (PARTITION BY job ORDER BY place) AS last FROM t WHERE moves),
    s AS (SELECT *, sum(CASE WHEN ts > last + INTERVAL 3 DAYS THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY place) AS stalls FROM u),
    c AS (SELECT *, count(*) FILTER (kind = 'item') OVER (PARTITION BY job ORDER BY place) AS reports FROM s WHERE stalls = 0),
    l AS (SELECT *, greatest(coalesce(max(CASE WHEN kind = 'poll' THEN n - reports END) OVER (PARTITION BY job ORDER BY place), 0), 0) AS lost FROM c),
    f AS (SELECT *, count(*) FILTER (reports + lost >= CASE job WHEN 3 THEN 1000000 ELSE 90 END) OVER (PARTITION BY job ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over FROM l)
    SELECT job, CASE job WHEN 3 THEN 1000000 ELSE 90 END::BIGINT AS total, count(*) FILTER (kind = 'item' AND ok) AS updated, count(*) FILTER (kind = 'item' AND NOT ok) + max(lost) AS failed, max(lost)::BIGINT AS lost, count(*) FILTER (kind = 'item') + max(lost) AS current, max(ts) AS last_at, CASE WHEN count(*) FILTER (kind = 'item') + max(lost) >= CASE job WHEN 3 THEN 1000000 ELSE 90 END THEN 'complete' ELSE 'stalled' END AS reason FROM f WHERE over = 0 GROUP BY job""")
def back_fill_progress(spark, d):
    return jobs.back_filled(back_fill_messages(spark, d), F.when(F.col("job") == 3, 1000000).otherwise(90), 3 * 24 * 60)


def back_fill_messages(spark, d):
    """Five jobs whose counter runs ahead of the reports that arrive; one never ends."""
    from pyspark.sql import Window

    key = F.col("event_id")
    rows = v.table(spark, d, "events").where("event_id % 3 <> 1").select((F.col("user_id") % 5).alias("job"), "ts", "event_id", F.when(key % 10 == 0, "poll").otherwise("item").alias("kind"), (key % 6 != 0).alias("ok"))
    place = F.row_number().over(Window.partitionBy("job").orderBy("ts", "kind", "event_id"))
    told = rows.withColumn("place", place).withColumn("n", F.when(F.col("kind") == "poll", F.col("place") + F.floor(F.col("place") / 10)))
    return told.drop("event_id", "place")


@query("duplicate_records", "SELECT post_id, arg_max(event_id, (ts, event_id)) AS last FROM (SELECT event_id % 40 AS post_id, ts, event_id FROM events) WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 2 DAYS GROUP BY post_id")
def duplicate_records(spark, d):
    """What is still held of records that live for two days."""
    e = v.table(spark, d, "events").select((F.col("event_id") % 40).alias("post_id"), "ts", F.col("event_id").alias("last"))
    now = str(e.agg(F.max("ts")).first()[0])  # one value
    return jobs.fresh(e, now, 2 * 24 * 3600, ["post_id"]).select("post_id", "last")


@query("post_phases", """WITH l AS (SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'claimed' WHEN 'click' THEN 'processed' WHEN 'purchase' THEN 'done' ELSE CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE 'invalid' END END AS kind FROM events WHERE event_type <> 'error' OR event_id % 5 = 0),
    e AS (SELECT id, min(seq) FILTER (kind IN ('done', 'failed', 'invalid')) AS ends FROM l GROUP BY id)
    SELECT id, arg_max(kind, seq) AS phase, arg_max(kind, seq) IN ('failed', 'invalid') AS deleted, CASE WHEN arg_max(kind, seq) IN ('failed', 'invalid') THEN 1 ELSE 0 END AS failures FROM l JOIN e USING (id) WHERE ends IS NULL OR seq <= ends GROUP BY id""")
def post_phases(spark, d):
    e = v.table(spark, d, "events").where("event_type <> 'error' OR event_id % 5 = 0")
    kind = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "claimed").when(F.col("event_type") == "click", "processed").when(F.col("event_type") == "purchase", "done").when(F.col("event_id") % 2 == 0, "failed").otherwise("invalid")
    return ingest.phases(e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), kind.alias("kind")))


@query("redacted_bodies", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"b":' || event_id || ',"password":"[REDACTED]"}' WHEN 1 THEN '{"a":{"name":"n' || event_id || '","token":"[REDACTED]"},"list":[{"secret":1}]}' WHEN 2 THEN '[body too large to log]' WHEN 3 THEN '[non-JSON body]' END AS body FROM events""")
def redacted_bodies(spark, d):
    """Values that are arrays and objects, fields in objects and in arrays, bodies that are too large, no JSON and empty."""
    key = F.col("event_id").cast("string")
    kinds = [F.concat(F.lit('{"password": [1, {"x": "}"}], "b": '), key, F.lit("}")), F.concat(F.lit('{"list": [{"secret": 1}], "a": {"token": {"y": "\\"z"}, "name": "n'), key, F.lit('"}}')), F.concat(F.lit('{"a": "'), F.repeat(F.lit("x"), 2048), F.lit('"}')), F.concat(F.lit("name="), key), F.lit("")]
    body = reduce(lambda out, k: out.when(F.col("event_id") % 5 == k, kinds[k]), range(1, 5), F.when(F.col("event_id") % 5 == 0, kinds[0]))
    return v.table(spark, d, "events").select("event_id", text.redacted(body).alias("body"))


# Changes of several tables

@query("dml_remove_tag", """SELECT 'post_tags' AS tbl, id, CAST(tag_id AS VARCHAR) AS what FROM post_tags WHERE NOT (post_id = 7 AND tag_id = (SELECT min(tag_id) FROM post_tags WHERE post_id = 7))
    UNION ALL SELECT 'tag_votes', id, CAST(post_id % 7 AS VARCHAR) FROM post_tags WHERE NOT (post_id = 7 AND tag_id = (SELECT min(tag_id) FROM post_tags WHERE post_id = 7))
    UNION ALL SELECT 'posts', id, CASE WHEN id = 7 THEN 'sfw' ELSE label END FROM posts""", "post_tags", "posts")
def dml_remove_tag(spark, d):
    # Numbers of the stand-in's links repeat, within a post and over posts; a vote belongs to one link, so links go by all that tells them apart.
    links = v.post_tags(spark, d).withColumn("id", F.struct("post_id", "id", "tag_id"))
    tag = links.where("post_id = 7").agg(F.min("tag_id")).first()[0]  # one value
    tag_votes = links.select(F.col("id").alias("entity"), (F.col("post_id") % 7).alias("user_id"))
    out = mutate.tag_removed(7, tag, links, tag_votes, v.tags(spark, d), v.posts(spark, d))
    part = lambda name, key, what: out[name].select(F.lit(name).alias("tbl"), F.col(key).cast("long").alias("id"), F.col(what).cast("string").alias("what"))
    return part("post_tags", "id.id", "tag_id").unionByName(part("tag_votes", "entity.id", "user_id")).unionByName(part("posts", "id", "label"))


RELEASES = "r AS (SELECT *, CASE WHEN id % 4 = 0 THEN -1 ELSE user_id END AS asker FROM posts WHERE id % 2 = 0), ok AS (SELECT * FROM r WHERE NOT deleted AND user_id = asker AND NOT dirty AND NOT released)"


@query("dml_release_all", f"""WITH posts AS ({v.SQL['posts']}), tags AS ({v.SQL['named_tags']}), post_tags AS ({v.SQL['post_tags']}), comments AS ({v.SQL['comments']}), {RELEASES},
    first AS (SELECT post_id, min(tag_id) AS tag_id FROM post_tags GROUP BY post_id),
    names AS (SELECT DISTINCT id, user_id, unnest(['fresh' || id % 3, CASE WHEN id % 3 = 1 THEN 'nsfw' ELSE 'fresh' || id % 3 END]) AS name FROM ok UNION SELECT ok.id, ok.user_id, t.name FROM ok JOIN first ON first.post_id = ok.id JOIN tags t ON t.id = first.tag_id),
    made AS (SELECT DISTINCT name FROM names WHERE name NOT IN (SELECT name FROM tags)),
    new_links AS (SELECT n.id, n.user_id, n.name FROM names n WHERE n.name IN (SELECT name FROM made) UNION ALL SELECT n.id, n.user_id, n.name FROM names n JOIN tags t USING (name) WHERE NOT EXISTS (SELECT 1 FROM post_tags x WHERE x.post_id = n.id AND x.tag_id = t.id))
    SELECT 'status' AS tbl, id, CASE WHEN deleted THEN 'not_found' WHEN user_id <> asker THEN 'forbidden' WHEN dirty THEN 'unfinished' WHEN released THEN 'already' ELSE 'ok' END AS what FROM r
    UNION ALL SELECT 'posts', id, CASE WHEN id % 3 = 1 AND id IN (SELECT id FROM ok) THEN 'nsfw' ELSE label END || CASE WHEN released OR id IN (SELECT id FROM ok) THEN ' released' ELSE '' END FROM posts
    UNION ALL SELECT 'tags', 0, name FROM tags UNION ALL SELECT 'tags', 0, name FROM made
    UNION ALL SELECT 'links', post_id, id::VARCHAR || ' ' || tag_id FROM post_tags
    UNION ALL SELECT 'new links', id, name || ' ' || user_id FROM new_links
    UNION ALL SELECT 'new ids', (SELECT max(id) FROM post_tags) + row_number() OVER (), 'link' FROM new_links
    UNION ALL SELECT 'comments', post_id, content FROM comments
    UNION ALL SELECT 'new comments', id, 'hello ' || id FROM ok WHERE id % 5 <> 0
    UNION ALL SELECT 'new ids', (SELECT max(id) FROM comments) + row_number() OVER (), 'comment' FROM ok WHERE id % 5 <> 0""")
def dml_release_all(spark, d):
    """Requests to release every second post, some of them another user's, with a tag that the post has, some that are new and a keyword; links and comments that are there stay."""
    p, key, tags, old = v.posts(spark, d), F.col("id"), v.named_tags(spark, d), v.post_tags(spark, d)
    first = old.groupBy("post_id").agg(F.min("tag_id").alias("tag_id")).join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").select(F.col("post_id").alias("id"), "name")
    fresh = F.concat(F.lit("fresh"), (key % 3).cast("string"))
    names = F.array(F.concat(F.lit(" "), fresh, F.lit(" ")), F.coalesce("name", F.lit("")), F.lit("  "), F.when(key % 3 == 1, "nsfw").otherwise(fresh))
    asked = p.where("id % 2 = 0").join(first, "id", "left").select("id", F.when(key % 4 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("user_id"), names.alias("tags"), F.when(key % 5 == 0, " ").otherwise(F.concat(F.lit(" hello "), key.cast("string"))).alias("comment"))
    links = old.withColumn("user_id", F.lit(None).cast("long"))
    said = v.comments(spark, d).select("id", "post_id", F.lit(None).cast("long").alias("user_id"), "content")
    out = mutate.release(asked, p, tags, links, said, what=F.concat_ws(" ", "name", F.col("user_id").cast("string")))
    row = lambda rows, tbl, which, what: rows.select(F.lit(tbl).alias("tbl"), which.cast("long").alias("id"), what.alias("what"))
    parts = [
        row(out["status"], "status", key, F.col("status")),
        row(out["posts"], "posts", key, F.concat("label", F.when(F.col("released"), " released").otherwise(""))),
        row(out["tags"], "tags", F.lit(0), F.col("name")),
        row(out["post_tags"].where("user_id IS NULL"), "links", F.col("post_id"), F.concat_ws(" ", key.cast("string"), F.col("tag_id").cast("string"))),
        row(out["new_links"].where("user_id IS NOT NULL"), "new links", F.col("post_id"), F.col("what")),
        row(out["post_tags"].where("user_id IS NOT NULL"), "new ids", key, F.lit("link")),
        row(out["comments"].where("user_id IS NULL"), "comments", F.col("post_id"), F.col("content")),
        row(out["comments"].where("user_id IS NOT NULL"), "new comments", F.col("post_id"), F.col("content")),
        row(out["comments"].where("user_id IS NOT NULL"), "new ids", key, F.lit("comment")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("dml_cascade_all", f"""WITH p AS (SELECT id FROM ({v.SQL['posts']}) WHERE id % 5 <> 0), t AS (SELECT id FROM ({v.SQL['tags']}) WHERE id % 4 <> 0), u AS (SELECT id FROM ({v.SQL['users']}) WHERE id % 6 <> 0),
    c AS (SELECT id, parent_id FROM ({v.SQL['comments']}) WHERE post_id IN (SELECT id FROM p)), x AS (SELECT id FROM ({v.SQL['post_tags']}) WHERE post_id IN (SELECT id FROM p) AND tag_id IN (SELECT id FROM t)),
    votes AS ({v.SQL['votes']})
    SELECT 'comments' AS tbl, id, CASE WHEN parent_id IN (SELECT id FROM c) THEN parent_id END AS what FROM c
    UNION ALL SELECT 'post_tags', id, NULL FROM x
    UNION ALL SELECT 'post_votes', entity, user_id FROM votes WHERE entity IN (SELECT id FROM p) AND user_id IN (SELECT id FROM u)
    UNION ALL SELECT 'comment_votes', entity, user_id FROM votes WHERE entity IN (SELECT id FROM c) AND user_id IN (SELECT id FROM u)
    UNION ALL SELECT 'tag_votes', entity, user_id FROM votes WHERE entity IN (SELECT id FROM x) AND user_id IN (SELECT id FROM u)
    UNION ALL SELECT 'messages', m.id, CASE WHEN m.ref_post_id IN (SELECT id FROM p) THEN m.ref_post_id END FROM ({v.SQL['messages']}) m""")
def dml_cascade_all(spark, d):
    """What is left of all tables when every fifth post, fourth tag and sixth user is gone."""
    log = v.votes(spark, d).select("entity", "user_id")
    tables = {"posts": v.posts(spark, d).where("id % 5 <> 0"), "tags": v.tags(spark, d).where("id % 4 <> 0"), "users": v.users(spark, d).where("id % 6 <> 0"), "comments": v.comments(spark, d), "post_tags": v.post_tags(spark, d), "post_votes": log, "comment_votes": log, "tag_votes": log, "messages": v.messages(spark, d)}
    out = mutate.cascaded(tables)
    part = lambda name, key, what: out[name].select(F.lit(name).alias("tbl"), F.col(key).cast("long").alias("id"), what.cast("long").alias("what"))
    kinds = [part("comments", "id", F.col("parent_id")), part("post_tags", "id", F.lit(None)), *[part(n, "entity", F.col("user_id")) for n in ("post_votes", "comment_votes", "tag_votes")], part("messages", "id", F.col("ref_post_id"))]
    return reduce(DataFrame.unionByName, kinds)
