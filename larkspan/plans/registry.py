"""Registered queries over the stand-ins, each with SQL that phrases it another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import kernels, labels, text
from larkspan.operators import discuss, feed, ingest, integrity, jobs, lookup, messages, mutate, search, similarity, stats, tagging, votes
from larkspan.plans import views as v
from larkspan.plans.views import with_views
from larkspan.sources import feeds
from larkspan.sources.scratch import folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LABELS = ["sfw", "nsfp"]
SEEN = "NOT deleted AND NOT dirty AND released AND label IN ('sfw', 'nsfp')"
POST, USER = 7001, 3
NOW = "2030-01-01 00:00:00"


def query(name: str, sql: str | None = None, *over: str):
    """Registers a query; `over`: the stand-ins that its SQL reads."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql, *over) if over else sql
        return f

    return add


# Feed

@query("feed_page", f"SELECT id, user_id, label, created_at, score FROM (SELECT *, row_number() OVER (ORDER BY id DESC) AS n FROM posts WHERE {SEEN}) WHERE n BETWEEN 51 AND 100", "posts")
def feed_page(spark, d):
    return feed.page(v.posts(spark, d), LABELS, 2).select("id", "user_id", "label", "created_at", "score")


def _latest(spark, d):
    return votes.latest(v.votes(spark, d))


LATEST = "(SELECT entity, user_id, vote FROM (SELECT *, row_number() OVER (PARTITION BY entity, user_id ORDER BY seq DESC) AS n FROM votes) WHERE n = 1 AND vote <> 0)"


@query("feed_voted", f"SELECT id, label, CAST(coalesce((SELECT max(vote) FROM {LATEST} l WHERE l.entity = p.id AND l.user_id = {USER}), 0) AS SMALLINT) AS vote FROM posts p WHERE {SEEN} ORDER BY id DESC LIMIT 50", "posts", "votes")
def feed_voted(spark, d):
    return feed.with_vote(feed.page(v.posts(spark, d), LABELS), _latest(spark, d), USER).select("id", "label", "vote")


@query("post_voted", f"SELECT id, label, CAST(coalesce((SELECT vote FROM {LATEST} l WHERE l.entity = p.id AND l.user_id = v.user_id), 0) AS SMALLINT) AS vote FROM posts p, (SELECT min(entity) AS entity FROM {LATEST} WHERE entity IN (SELECT id FROM posts WHERE {SEEN})) e, (SELECT min(user_id) AS user_id FROM {LATEST} l WHERE entity = (SELECT min(entity) FROM {LATEST} WHERE entity IN (SELECT id FROM posts WHERE {SEEN}))) v WHERE p.id = e.entity", "posts", "votes")
def post_voted(spark, d):
    """The first visible post with a vote, for the first user who voted on it."""
    last, seen = _latest(spark, d), v.posts(spark, d).where(labels.visible(LABELS))
    voted = last.join(seen.select(F.col("id").alias("entity")), "entity", "left_semi").agg(F.min(F.struct("entity", "user_id")).alias("first")).first().first  # one row
    return feed.with_vote(lookup.by_key(seen, "id", voted.entity), last, voted.user_id).select("id", "label", "vote")


@query("posts_by_user", f"SELECT id, label, created_at FROM posts WHERE {SEEN} AND user_id = {USER}", "posts")
def posts_by_user(spark, d):
    return feed.by_user(v.posts(spark, d), USER, LABELS).select("id", "label", "created_at")


@query("posts_older", f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id DESC) AS n FROM posts WHERE {SEEN} AND id < {POST}) WHERE n <= 50", "posts")
def posts_older(spark, d):
    return feed.older(v.posts(spark, d), LABELS, POST).select("id")


@query("posts_newer_compat", f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) AS n, count(*) OVER () AS c FROM posts WHERE {SEEN} AND id > {POST}) WHERE CASE WHEN c > 50 THEN n BETWEEN 2 AND 51 ELSE true END", "posts")
def posts_newer_compat(spark, d):
    return feed.newer(v.posts(spark, d), LABELS, POST).select("id")


@query("posts_newer_contiguous", f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) AS n FROM posts WHERE {SEEN} AND id > {POST}) WHERE n <= 50", "posts")
def posts_newer_contiguous(spark, d):
    return feed.newer(v.posts(spark, d), LABELS, POST, mode="contiguous").select("id")


@query("posts_has_more", f"SELECT (SELECT count(*) FROM posts WHERE {SEEN} AND id < {POST}) > 50 AS has_more", "posts")
def posts_has_more(spark, d):
    return feed.has_more(v.posts(spark, d), LABELS, POST)


@query("posts_around", f"SELECT * FROM (WITH w AS (SELECT id, row_number() OVER (ORDER BY id) AS n, count(*) OVER () AS c FROM posts WHERE {SEEN} AND id > {POST}), o AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS n, count(*) OVER () AS c FROM posts WHERE {SEEN} AND id < {POST}), a AS (SELECT id FROM w WHERE CASE WHEN c > 10 THEN n BETWEEN 2 AND 11 ELSE true END UNION ALL SELECT id FROM posts WHERE {SEEN} AND id = {POST} UNION ALL SELECT id FROM o WHERE n <= 10) SELECT id, coalesce((SELECT max(c) FROM w) > 10, false) AS has_newer, coalesce((SELECT max(c) FROM o) > 10, false) AS has_older FROM a)", "posts")
def posts_around(spark, d):
    """A window around a post as clients see it: of the newer posts one more is read, and then the nearest is dropped."""
    return feed.around(v.posts(spark, d), LABELS, POST, 10).select("id", "has_newer", "has_older")


@query("post_position", f"SELECT position, position // 50 + 1 AS page FROM (SELECT count(*) AS position FROM posts WHERE {SEEN} AND id > {POST})", "posts")
def post_position(spark, d):
    return feed.position(v.posts(spark, d), LABELS, POST)


@query("post_positions_all", f"SELECT id, row_number() OVER (ORDER BY id DESC) - 1 AS position FROM posts WHERE {SEEN}", "posts")
def post_positions_all(spark, d):
    return feed.ranked(v.posts(spark, d).where(labels.visible(LABELS)).select("id")).select("id", "position")


@query("neighbours", f"SELECT id, lag(id) OVER w AS newer_id, lead(id) OVER w AS older_id FROM posts WHERE {SEEN} WINDOW w AS (ORDER BY id DESC)", "posts")
def neighbours(spark, d):
    return feed.neighbours(v.posts(spark, d), LABELS)


@query("grid_rows", f"SELECT \"row\", kind, array_to_string(ids, ',') AS ids FROM (SELECT (n - 1) // 6 AS \"row\", 'posts' AS kind, list(id ORDER BY id DESC) AS ids FROM (SELECT id, row_number() OVER (ORDER BY id DESC) AS n FROM posts WHERE {SEEN}) GROUP BY 1 UNION ALL SELECT (n - 1) // 6, 'expanded', [id] FROM (SELECT id, row_number() OVER (ORDER BY id DESC) AS n FROM posts WHERE {SEEN}) WHERE id = {POST})", "posts")
def grid_rows(spark, d):
    return feed.grid_rows(v.posts(spark, d), LABELS, 6, POST).withColumn("ids", F.array_join("ids", ","))


@query("page_cursor", f"SELECT min(id) AS oldest, max(id) AS newest FROM (SELECT id FROM posts WHERE {SEEN} ORDER BY id DESC LIMIT 50)", "posts")
def page_cursor(spark, d):
    return feed.next_cursor(feed.page(v.posts(spark, d), LABELS))


ASKED = ["", "sfw", "secret,sfw", " nsfp , nsfp ,nsfw", "bogus"]


@query("visible_labels", f"""SELECT event_id, level, CASE WHEN requested = '' THEN array_to_string(allowed, ',') ELSE coalesce((SELECT string_agg(name, ',' ORDER BY place) FROM (SELECT name, min(place) AS place FROM (SELECT trim(unnest(string_split(requested, ','))) AS name, unnest(generate_series(1, len(string_split(requested, ',')))) AS place) WHERE list_contains(allowed, name) GROUP BY name)), '') END AS labels
    FROM (SELECT event_id, {ASKED}[event_id % 5 + 1] AS requested, level, CASE WHEN level >= 5 THEN ['sfw', 'nsfp', 'nsfw', 'secret'] WHEN level >= 1 THEN ['sfw', 'nsfp', 'nsfw'] ELSE ['sfw'] END AS allowed FROM events JOIN users ON id = user_id)""", "users")
def visible_labels(spark, d):
    """What each request may show: the labels that it asks for, of those that its user's level may see."""
    asked = v.table(spark, d, "events").select("event_id", "user_id", F.element_at(F.array(*[F.lit(x) for x in ASKED]), (F.col("event_id") % 5 + 1).cast("int")).alias("requested"))
    both = asked.join(v.users(spark, d).select(F.col("id").alias("user_id"), "level"), "user_id")
    return both.select("event_id", "level", F.array_join(labels.allowed_filters_column(F.col("requested"), F.col("level")), ",").alias("labels"))


# Search, tags, comments

@query("search_tags", f"SELECT DISTINCT p.id, p.user_id, p.label FROM posts p JOIN post_tags x ON x.post_id = p.id JOIN tags t ON t.id = x.tag_id WHERE t.name IN ('Brand#11', 'Brand#23') AND {SEEN}", "posts", "post_tags", "tags")
def search_tags(spark, d):
    return search.by_tags(v.posts(spark, d), v.post_tags(spark, d), v.tags(spark, d), search.parse_path("Brand#11%20Brand#23"), LABELS).select("id", "user_id", "label")


@query("search_tags_user", f"SELECT DISTINCT p.id FROM posts p JOIN post_tags x ON x.post_id = p.id JOIN tags t ON t.id = x.tag_id WHERE t.name IN ('Brand#11', 'Brand#23', 'Brand#12') AND {SEEN} AND p.user_id = {USER}", "posts", "post_tags", "tags")
def search_tags_user(spark, d):
    return search.by_tags(v.posts(spark, d), v.post_tags(spark, d), v.tags(spark, d), ["Brand#11", "Brand#23", "Brand#12"], LABELS, USER).select("id")


@query("posts_with_tag", "SELECT DISTINCT post_id FROM post_tags WHERE tag_id = 17", "post_tags")
def posts_with_tag(spark, d):
    return search.ids_with_tag(v.post_tags(spark, d), 17)


@query("tag_suggest", "SELECT id, name FROM named_tags t WHERE contains(lower(name), 'nvi') AND NOT EXISTS (SELECT 1 FROM (SELECT name AS n FROM named_tags WHERE id IN (1, 10)) x WHERE lower(x.n) = lower(t.name)) ORDER BY id LIMIT 8", "named_tags")
def tag_suggest(spark, d):
    tags = v.named_tags(spark, d)
    existing = [r[0] for r in tags.where("id IN (1, 10)").select("name").collect()]  # the names that a post has, a few
    return search.suggestions(tags, "NVI", existing).select("id", "name")


@query("tags_of_post_top5", f"SELECT x.post_id, x.id, t.name, x.score, CAST(coalesce(l.vote, 0) AS SMALLINT) AS vote, greatest(count(*) OVER (PARTITION BY x.post_id) - 5, 0) AS hidden FROM post_tags x LEFT JOIN tags t ON t.id = x.tag_id LEFT JOIN (SELECT * FROM {LATEST} WHERE user_id = {USER}) l ON l.entity = x.id QUALIFY row_number() OVER (PARTITION BY x.post_id ORDER BY x.score DESC, x.id, x.tag_id) <= 5", "post_tags", "tags", "votes")
def tags_of_post_top5(spark, d):
    rows = discuss.tags_of_posts(v.post_tags(spark, d), v.tags(spark, d), _latest(spark, d), USER)
    return discuss.top_tags(rows).select("post_id", "id", "name", "score", "vote", "hidden")


@query("comments_voted", f"SELECT c.id, c.post_id, c.\"user\", CAST(coalesce((SELECT max(vote) FROM {LATEST} l WHERE l.entity = c.id AND l.user_id = {USER}), 0) AS SMALLINT) AS vote FROM comments c", "comments", "votes")
def comments_voted(spark, d):
    return feed.with_vote(v.comments(spark, d), _latest(spark, d), USER).select("id", "post_id", "user", "vote")


TREE = "known AS (SELECT c.id, c.post_id, p.id AS parent FROM comments c LEFT JOIN comments p ON p.id = c.parent_id), tree AS (SELECT id, 0 AS depth, id AS root_id, CAST(id AS VARCHAR) AS path FROM known WHERE parent IS NULL UNION ALL SELECT k.id, t.depth + 1, t.root_id, t.path || '/' || k.id FROM known k JOIN tree t ON k.parent = t.id)"


def comment_tree(spark, d):
    tree = discuss.comment_tree(v.comments(spark, d))
    return tree.select("id", "depth", "root_id", F.array_join("path", "/").alias("path"), text.indent(F.col("depth")).alias("indent"))


QUERIES["comment_tree"] = comment_tree
ORACLE_SQL["comment_tree"] = f"WITH RECURSIVE comments AS ({v.SQL['comments']}), {TREE} SELECT id, depth, root_id, path, least(depth, 8) * 16 AS indent FROM tree"


@query("reply_notifications", """SELECT 'notification' AS kind, c."user" AS from_user, p."user" AS to_user, '@' || c."user" || ' replied to your comment' || CASE WHEN coalesce(c.content, '') = '' THEN '' WHEN strlen(c.content) > 120 THEN ': “' || left(c.content, (SELECT max(n)::INT FROM (SELECT unnest(generate_series(0, 120)) AS n) WHERE strlen(left(c.content, n::INT)) <= 120)) || '…”' ELSE ': “' || c.content || '”' END AS body, c.post_id AS ref_post_id, c.id AS ref_comment_id FROM comments c JOIN comments p ON p.id = c.parent_id WHERE p."user" <> c."user" AND p."user" <> ''""", "comments")
def reply_notifications(spark, d):
    return discuss.reply_notifications(v.comments(spark, d))


# Messages

MINE = "SELECT *, CASE WHEN from_id = 3 THEN to_id ELSE from_id END AS partner FROM messages WHERE kind = 'private' AND (from_id = 3 OR to_id = 3)"


@query("inbox", f"SELECT partner, max(created_at) AS last_at, max(CASE WHEN n = 1 THEN id END) AS last_id, max(CASE WHEN n = 1 THEN body END) AS last_body, count(*) FILTER (to_id = 3 AND NOT is_read) AS unread FROM (SELECT *, row_number() OVER (PARTITION BY partner ORDER BY created_at DESC, id DESC) AS n FROM ({MINE})) GROUP BY partner", "messages")
def inbox(spark, d):
    return messages.inbox(v.messages(spark, d), USER)


@query("inboxes_all", "SELECT me, partner, max(created_at) AS last_at, arg_max(id, (created_at, id)) AS last_id, count(*) FILTER (new) AS unread FROM (SELECT from_id AS me, to_id AS partner, created_at, id, false AS new FROM messages WHERE kind = 'private' UNION ALL SELECT to_id, from_id, created_at, id, NOT is_read FROM messages WHERE kind = 'private') GROUP BY me, partner", "messages")
def inboxes_all(spark, d):
    return messages.inboxes(v.messages(spark, d))


@query("private_messages", f"SELECT id, partner FROM ({MINE})", "messages")
def private_messages(spark, d):
    return messages.private(v.messages(spark, d), USER).select("id", F.when(F.col("from_id") == USER, F.col("to_id")).otherwise(F.col("from_id")).alias("partner"))


@query("thread", f"SELECT id, from_id, to_id, created_at FROM ({MINE}) WHERE partner = (SELECT min(partner) FROM ({MINE}))", "messages")
def thread(spark, d):
    """The thread with the first partner of the user's private messages."""
    mine = v.messages(spark, d)
    partner = messages.inbox(mine, USER).agg(F.min("partner")).first()[0]  # one value
    return messages.thread(mine, USER, partner).select("id", "from_id", "to_id", "created_at")


@query("unread_count", "SELECT CAST(sum(CASE WHEN to_id = 3 AND NOT is_read THEN 1 ELSE 0 END) AS INT) AS unread FROM messages", "messages")
def unread_count(spark, d):
    return messages.unread_count(v.messages(spark, d), USER)


@query("notifications_page", "SELECT id, kind, from_id, created_at, is_read, ref_post_id, ref_comment_id, (SELECT max(label) FROM posts p WHERE p.id = m.ref_post_id) AS post_label, (SELECT max(\"user\") FROM comments c WHERE c.id = m.ref_comment_id) AS comment_user FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS n FROM messages WHERE to_id = 3 AND kind <> 'private') m WHERE n BETWEEN 1 AND 20", "messages", "posts", "comments")
def notifications_page(spark, d):
    return messages.notifications(v.messages(spark, d), v.posts(spark, d), v.comments(spark, d), USER)


@query("broadcast", "SELECT 'system' AS kind, id AS to_id, 'Hello' AS body, TIMESTAMP '2030-01-01 00:00:00' AS created_at FROM users", "users")
def broadcast(spark, d):
    return messages.broadcast(v.users(spark, d), "Hello", NOW)


# Votes

@query("vote_scores", "SELECT entity, CAST(sum(vote) AS BIGINT) AS score FROM (SELECT entity, user_id, arg_max(vote, seq) AS vote FROM votes GROUP BY entity, user_id) GROUP BY entity", "votes")
def vote_scores(spark, d):
    return votes.scores(v.votes(spark, d))


@query("user_vote_table", f"SELECT entity, user_id, CAST(vote AS SMALLINT) AS vote FROM {LATEST}", "votes")
def user_vote_table(spark, d):
    return _latest(spark, d)


@query("vote_deltas", "SELECT seq, entity, user_id, CAST(vote - coalesce(lag(vote) OVER (PARTITION BY entity, user_id ORDER BY seq), 0) AS INT) AS delta FROM votes", "votes")
def vote_deltas(spark, d):
    return votes.deltas(v.votes(spark, d)).select("seq", "entity", "user_id", "delta")


@query("preload_scores", f"SELECT entity_type, entity, CAST(coalesce(sum(vote), 0) AS BIGINT) AS score FROM (SELECT 'post' AS entity_type, entity, vote FROM {LATEST} UNION ALL SELECT 'comment', entity * 100, vote FROM {LATEST} WHERE user_id % 2 = 0 UNION ALL SELECT 'post_tag', entity * 10 + 1, vote FROM {LATEST} WHERE user_id % 3 = 0) GROUP BY 1, 2", "votes")
def preload_scores(spark, d):
    last = _latest(spark, d)
    return votes.preloaded(last, last.where("user_id % 2 = 0").withColumn("entity", F.col("entity") * 100), last.where("user_id % 3 = 0").withColumn("entity", F.col("entity") * 10 + 1))


@query("vote_upsert", "SELECT entity, user_id, CAST(vote AS SMALLINT) AS vote FROM (SELECT *, row_number() OVER (PARTITION BY entity, user_id ORDER BY seq DESC) AS n FROM votes) WHERE n = 1 AND vote <> 0", "votes")
def vote_upsert(spark, d):
    log = v.votes(spark, d)
    return votes.upserted(votes.latest(log.where("seq % 10 < 5 AND seq < 5000")), log.where("NOT (seq % 10 < 5 AND seq < 5000) OR seq >= 0"))


@query("vote_scores_stream", ORACLE_SQL["vote_scores"])
def vote_scores_stream(spark, d):
    """The stream over the whole vote log, run to its end; the last score of each entity."""
    from larkspan.streaming.runs import run_to_end, written
    from larkspan.streaming.votes import latest_scores, stream_scores

    path = f"{d}/events.parquet"
    source = v.table(spark, d, "events")
    out = folder(spark, "scores")
    stream = spark.readStream.schema(source.schema).parquet(path if _folder(spark, path) else f"{d}/events*.parquet")
    run_to_end(stream_scores(v.votes_of(stream).drop("ts")), out, folder(spark, "votes"))
    return latest_scores(written(spark, out, "entity bigint, score bigint"))


def _folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


# Import and queue

@query("import_dedup_batch", "SELECT doc_id FROM documents c WHERE doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM documents t WHERE t.doc_id % 2 = 1 AND t.text = c.text)")
def import_dedup_batch(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id", "text")
    return ingest.batch_dedup(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "text").select("doc_id")


@query("import_dedup_sequential", "SELECT min(doc_id) AS doc_id FROM documents c WHERE doc_id % 2 = 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 1) GROUP BY text")
def import_dedup_sequential(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id", "text")
    return ingest.sequential_dedup(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "text", "doc_id").select("doc_id")


NAMES = "SELECT page_id, 'img' || page_id || CASE page_id % 7 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPG' WHEN 2 THEN '.mp4' WHEN 3 THEN '' WHEN 4 THEN '.webp' WHEN 5 THEN '.png' ELSE '.bin' END AS image, page_id % 5 = 1 AS known, page_id % 13 <> 4 AS ok FROM pages"


def _items(spark, d):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".jpg", ".JPG", ".mp4", "", ".webp", ".png", ".bin")]), (F.col("page_id") % 7 + 1).cast("int"))
    return v.table(spark, d, "pages").select("page_id", F.concat(F.lit("img"), F.col("page_id").cast("string"), ext).alias("image"), (F.col("page_id") % 5 == 1).alias("known"), (F.col("page_id") % 13 != 4).alias("ok"))


@query("import_counters", f"WITH i AS ({NAMES}), o AS (SELECT *, lower(regexp_extract(image, '\\.[^./]*$')) IN ('.jxl', '.avif', '.webp', '.jpg', '.gif') AS fits, image IN (SELECT 'img' || doc_id || '.jpg' FROM documents WHERE doc_id % 5 = 0) AS there FROM i) SELECT count(*) AS total, count(*) FILTER (NOT fits) AS filtered_ext, count(*) FILTER (fits AND there) AS skipped_dedup, count(*) FILTER (fits AND NOT there AND NOT ok) AS insert_errors, count(*) FILTER (fits AND NOT there AND ok) AS inserted FROM o")
def import_counters(spark, d):
    there = v.table(spark, d, "documents").where("doc_id % 5 = 0").select(F.concat(F.lit("img"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image"))
    items = ingest.known(_items(spark, d).drop("known"), there, "image")
    return ingest.counters(items.withColumn("outcome", ingest.outcome(F.col("image"), F.col("known"), F.col("ok"))))


@query("file_types", f"WITH i AS ({NAMES}), e AS (SELECT page_id, lower(regexp_extract(image, '\\.([^./]*)$', 1)) AS x FROM i), k AS (SELECT * FROM (VALUES ('jpg', 'image/jpeg'), ('jpeg', 'image/jpeg'), ('png', 'image/png'), ('gif', 'image/gif'), ('webp', 'image/webp'), ('avif', 'image/avif'), ('jxl', 'image/jxl'), ('bmp', 'image/bmp'), ('tiff', 'image/tiff'), ('tif', 'image/tiff'), ('mp4', 'video/mp4'), ('webm', 'video/webm'), ('mov', 'video/quicktime'), ('mkv', 'video/x-matroska'), ('avi', 'video/x-msvideo')) t(x, type)) SELECT page_id, coalesce(k.type, 'unknown/' || e.x) AS type, coalesce(starts_with(k.type, 'video/'), false) AS video FROM e LEFT JOIN k ON k.x = e.x")
def file_types(spark, d):
    return _items(spark, d).select("page_id", text.file_type(F.col("image")).alias("type"), text.is_video(F.lit(None).cast("string"), F.col("image")).alias("video"))


@query("load_until_500", "WITH p AS (SELECT event_id // 10 AS page, count(*) FILTER (event_id % 3 <> 0) AS inserted FROM events GROUP BY 1), r AS (SELECT page, inserted, coalesce(sum(inserted) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT page, inserted, CAST(before AS BIGINT) AS before FROM r WHERE before < 500")
def load_until_500(spark, d):
    by_page = v.table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 10).alias("page")).agg(F.count_if(F.col("event_id") % 3 != 0).alias("inserted"))
    return ingest.until_enough(by_page, 500)


@query("min_cursor", "SELECT min(page_id) AS cursor FROM pages WHERE page_id >= 40")
def min_cursor(spark, d):
    return ingest.min_cursor(v.table(spark, d, "pages").where("page_id >= 40"), "page_id")


@query("queue_position", "SELECT count(*) AS position FROM posts WHERE dirty AND NOT deleted AND id <= 1700", "posts")
def queue_position(spark, d):
    return ingest.queue_position(v.posts(spark, d), 1700)


@query("queue_positions_all", "SELECT id, row_number() OVER (ORDER BY id) AS position FROM posts WHERE dirty AND NOT deleted", "posts")
def queue_positions_all(spark, d):
    return ingest.queue_positions(v.posts(spark, d))


@query("queue_eta", "SELECT id, CAST(CASE WHEN n <= 3 THEN 777 ELSE ceil((n - 3) / 2.5) END AS INT) AS eta_sec, -1 AS unknown FROM (SELECT id, row_number() OVER (ORDER BY id) AS n FROM posts WHERE dirty AND NOT deleted)", "posts")
def queue_eta(spark, d):
    """Three posts are done since the positions were taken: who has no place any more gets the whole queue's estimate."""
    placed = ingest.queue_positions(v.posts(spark, d)).withColumn("position", F.col("position") - 3)
    return placed.select("id", ingest.eta(F.col("position"), F.lit(2.5), F.lit(777)).alias("eta_sec"), ingest.eta(F.col("position"), F.lit(0.0), F.lit(777)).alias("unknown"))


@query("dirty_posts", "SELECT id, user_id FROM posts WHERE NOT (NOT dirty OR deleted)", "posts")
def dirty_posts(spark, d):
    return v.posts(spark, d).where("dirty AND NOT deleted").orderBy("id").select("id", "user_id")


@query("user_unfinished_post", f"SELECT min(id) AS id FROM posts WHERE user_id = {USER} AND (dirty OR NOT released) AND NOT deleted HAVING min(id) IS NOT NULL", "posts")
def user_unfinished_post(spark, d):
    return ingest.first_unfinished(v.posts(spark, d), USER).select("id")


@query("post_is_dirty", "SELECT EXISTS (SELECT 1 FROM posts WHERE id = 1700 AND dirty) AS dirty", "posts")
def post_is_dirty(spark, d):
    return ingest.is_dirty(v.posts(spark, d), 1700)


@query("url_exists", "SELECT doc_id, count(page_id) > 0 AS known FROM documents LEFT JOIN pages ON page_id = doc_id GROUP BY doc_id")
def url_exists(spark, d):
    urls = v.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"))
    return ingest.known(v.table(spark, d, "documents").select("doc_id"), urls, "doc_id")


SOURCES = "SELECT id, user_id, CASE WHEN id % 3 = 0 THEN 'up' || user_id || '.png' WHEN id % 5 = 0 THEN '' END AS uploaded, CASE WHEN id % 2 = 0 THEN 'http://x/' || id WHEN id % 7 = 0 THEN '' END AS url FROM posts"


@query("source_resolution", f"SELECT id, CASE WHEN length(uploaded) > 0 THEN 'file' WHEN length(url) > 0 THEN 'url' ELSE 'invalid' END AS source FROM ({SOURCES})", "posts")
def source_resolution(spark, d):
    return _sources(spark, d).select("id", ingest.source_of(F.col("uploaded"), F.col("url")).alias("source"))


def _sources(spark, d):
    key = F.col("id")
    uploaded = F.when(key % 3 == 0, F.concat(F.lit("up"), F.col("user_id").cast("string"), F.lit(".png"))).when(key % 5 == 0, "")
    return v.posts(spark, d).withColumns({"uploaded": uploaded, "url": F.when(key % 2 == 0, F.concat(F.lit("http://x/"), key.cast("string"))).when(key % 7 == 0, "")})


@query("post_states", "SELECT id, CASE WHEN NOT dirty AND released THEN 'released' WHEN NOT dirty THEN 'finalized' WHEN id % 3 = 2 THEN 'deleted_invalid' WHEN id % 10 = 0 THEN 'deleted_duplicate' ELSE 'finalized' END AS state FROM posts", "posts")
def post_states(spark, d):
    p = v.posts(spark, d).withColumn("source", F.when(F.col("id") % 3 == 2, "invalid").otherwise("url"))
    return ingest.processed(p, p.where("id % 10 = 0").select("id")).select("id", "state")


@query("queue_counters", "SELECT count(*) AS total, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'active') AS active, count(*) FILTER (s = 'imported') AS imported, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s IN ('imported', 'failed')) AS processed FROM (SELECT entity, arg_max(CASE vote WHEN 0 THEN 'active' WHEN -1 THEN 'failed' ELSE CASE WHEN seq % 2 = 0 THEN 'imported' ELSE 'pending' END END, seq) AS s FROM votes GROUP BY entity)", "votes")
def queue_counters(spark, d):
    status = F.when(F.col("vote") == 0, "active").when(F.col("vote") == -1, "failed").when(F.col("seq") % 2 == 0, "imported").otherwise("pending")
    return ingest.queue_counters(v.votes(spark, d).select(F.col("entity").alias("id"), "seq", status.alias("status")))


@query("queue_snapshot", """SELECT coalesce(pending, n)::INT AS pending, coalesce(total, n)::INT AS total, coalesce(processed, 0)::INT AS processed, 0 AS imported, coalesce(failed, 0)::INT AS failed, coalesce(running, false) AS running, coalesce(rate, 0)::DOUBLE AS rate_per_sec, CASE WHEN rate > 0 THEN ceil(pending / rate) ELSE -1 END::INT AS eta_sec
    FROM (SELECT count(*) AS n FROM posts WHERE dirty AND NOT deleted) LEFT JOIN (SELECT event_id % 50 + 1 AS pending, event_id % 90 + 60 AS total, event_id % 70 AS processed, event_id % 4 AS failed, event_id % 2 = 0 AS running, (event_id % 8)::DOUBLE / 4 AS rate FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 60 SECONDS ORDER BY ts DESC, event_id DESC LIMIT 1) ON true""", "posts")
def queue_snapshot(spark, d):
    """The queue as its last status tells it, one of many in a log."""
    e = v.table(spark, d, "events")
    key, none = F.col("event_id"), F.lit(None)
    value = feeds.status_row(key % 50 + 1, key % 90 + 60, key % 70, none.cast("int"), key % 4, key % 2 == 0, (key % 8).cast("double") / 4, none.cast("int"))
    now = str(e.agg(F.max("ts")).first()[0])  # one value
    return feeds.queue_snapshot(e.select("ts", value.alias("value")), v.posts(spark, d), now)


# Labels

def _names(spark, d):
    quality = v.table(spark, d, "labels")
    name = F.when(F.col("toxic") == 1, "nsfw").when(F.col("quality") == 0, "secret").when(F.col("doc_id") % 3 == 0, "nsfp").otherwise("cat")
    return quality.select((F.col("doc_id") % 500).alias("post_id"), name.alias("name"))


NAMED = "names AS (SELECT doc_id % 500 AS post_id, CASE WHEN toxic = 1 THEN 'nsfw' WHEN quality = 0 THEN 'secret' WHEN doc_id % 3 = 0 THEN 'nsfp' ELSE 'cat' END AS name FROM labels)"


@query("label_from_tags_migration", None)
def label_from_tags_migration(spark, d):
    return tagging.relabelled(v.posts(spark, d), _names(spark, d), "migration").select("id", "label")


@query("label_from_tags_runtime", None)
def label_from_tags_runtime(spark, d):
    return tagging.relabelled(v.posts(spark, d), _names(spark, d), "runtime").select("id", "label")


LADDER = "CASE WHEN bool_or(name = 'secret') THEN 'secret' WHEN bool_or(name = 'nsfw') THEN 'nsfw' WHEN bool_or(name = 'nsfp') THEN 'nsfp' END"
for _mode, _other in (("migration", "p.label"), ("runtime", "'sfw'")):
    ORACLE_SQL[f"label_from_tags_{_mode}"] = f"WITH posts AS ({v.SQL['posts']}), {NAMED}, best AS (SELECT post_id, {LADDER} AS label FROM names GROUP BY post_id) SELECT p.id, coalesce(b.label, {_other}) AS label FROM posts p LEFT JOIN best b ON b.post_id = p.id"


@query("label_by_level", "SELECT id, CASE WHEN level >= 5 THEN 'secret' WHEN level >= 1 THEN 'nsfw' ELSE 'sfw' END AS label FROM users", "users")
def label_by_level(spark, d):
    return mutate.labels_by_level(v.users(spark, d), "level").select("id", "label")


# Pictures

PAIRS = f"WITH bits AS ({v.SQL['bits']}) SELECT a.id AS a_id, b.id AS b_id, CAST(list_sum(list_transform(list_zip(a.b, b.b), lambda x: CASE WHEN x[1] <> x[2] THEN 1 ELSE 0 END)) AS INT) AS distance FROM bits a JOIN bits b ON a.id < b.id WHERE distance < 90"


@query("near_duplicates", PAIRS)
def near_duplicates(spark, d):
    return similarity.near_duplicates(v.hashes(spark, d), 90)


#: Each picture, and a copy of every third with up to 30 bits of its first two words turned.
COPIES = f"bits AS ({v.SQL['bits']} UNION ALL SELECT vec_id + 10000000, list_transform(generate_series(0, 255), lambda i: (embedding[i % 64 + 1] > embedding[(i % 64 + i // 64 + 1) % 64 + 1]) <> (i < 128 AND (i * 7 + vec_id) % 128 < vec_id % 31)) FROM embeddings WHERE vec_id % 3 = 0)"


@query("near_duplicates_banded", f"WITH {COPIES} SELECT a.id AS a_id, b.id AS b_id, CAST(list_sum(list_transform(list_zip(a.b, b.b), lambda x: CASE WHEN x[1] <> x[2] THEN 1 ELSE 0 END)) AS INT) AS distance FROM bits a JOIN bits b ON a.id < b.id WHERE distance < 50")
def near_duplicates_banded(spark, d):
    """Through the chunk index, with the threshold of production."""
    h = v.hashes(spark, d)
    return similarity.near_duplicates(h.unionByName(copies(h)), 50)


def copies(hashes: DataFrame) -> DataFrame:
    """A copy of every third picture with up to 30 bits of its first two words turned."""
    def turned(k: int):
        places = [(i % 64, F.pmod(F.lit(i * 7) + F.col("id"), F.lit(128)) < F.col("id") % 31) for i in range(64 * k, 64 * k + 64)]
        mask = F.lit(0).cast("long")
        for bit, hit in places:
            mask = mask.bitwiseOR(F.when(hit, F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(0))
        return F.col(f"p_hash_{k}").bitwiseXOR(mask).alias(f"p_hash_{k}")

    return hashes.where("id % 3 = 0").select((F.col("id") + 10000000).alias("id"), turned(0), turned(1), "p_hash_2", "p_hash_3")


@query("possible_duplicates", f"WITH bits AS ({v.SQL['bits']}) SELECT a.id, CAST(list_sum(list_transform(list_zip(a.b, b.b), lambda x: CASE WHEN x[1] <> x[2] THEN 1 ELSE 0 END)) AS INT) AS distance FROM bits a, bits b WHERE b.id = 7 AND a.id <> 7 AND a.id % 17 <> 0 AND distance < 110")
def possible_duplicates(spark, d):
    h = v.hashes(spark, d).withColumn("dirty", F.col("id") % 17 == 0)
    words = h.where("id = 7").select(*similarity.WORDS).first()  # one row
    return similarity.duplicates_of(h, list(words), 110, exclude=7).select("id", "distance")


@query("dct_median_bits", "WITH c AS (SELECT vec_id, list_transform(generate_series(0, 15), lambda k: list_sum(list_transform(generate_series(0, 63), lambda x: embedding[x + 1]::DOUBLE * cos(pi() * k * (2 * x + 1) / 128)))) AS c FROM embeddings) SELECT vec_id, array_to_string(list_transform(c, lambda x: CASE WHEN x > (list_sort(c)[8] + list_sort(c)[9]) / 2 THEN '1' ELSE '0' END), '') AS bits FROM c")
def dct_median_bits(spark, d):
    rows = v.table(spark, d, "embeddings").withColumn("c", kernels.dct(F.col("embedding").cast("array<double>"), 64, 16)).withColumn("m", kernels.median(F.col("c")))
    return rows.select("vec_id", F.array_join(F.transform("c", lambda x: F.when(x > F.col("m"), "1").otherwise("0")), "").alias("bits"))


# Counts, jobs, formats

@query("admin_counts", "SELECT (SELECT count(*)::INT FROM posts WHERE NOT deleted AND NOT dirty) AS posts, (SELECT count(*)::INT FROM posts WHERE NOT deleted AND dirty) AS dirty_posts, (SELECT count(*)::INT FROM comments) AS comments, (SELECT count(*)::INT FROM tags) AS tags, (SELECT count(*)::INT FROM users) AS users", "posts", "comments", "tags", "users")
def admin_counts(spark, d):
    return stats.admin_counts(v.posts(spark, d), v.comments(spark, d), v.tags(spark, d), v.users(spark, d))


@query("disk_usage", "SELECT lang AS label, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) AS files FROM documents GROUP BY lang")
def disk_usage(spark, d):
    return feeds.disk_usage(v.table(spark, d, "documents").select(F.col("lang").alias("label"), F.col("n_chars").alias("length")))


@query("user_profile", f"SELECT count(*) AS n_posts, CAST(sum(score) AS BIGINT) AS score, min(created_at) AS since FROM posts WHERE user_id = {USER} HAVING count(*) > 0", "posts")
def user_profile(spark, d):
    return stats.user_profile(v.posts(spark, d), USER)


@query("user_profiles_all", "SELECT user_id, count(*) AS n_posts, CAST(sum(score) AS BIGINT) AS score, min(created_at) AS since FROM posts GROUP BY user_id", "posts")
def user_profiles_all(spark, d):
    return stats.user_profiles(v.posts(spark, d))


@query("backfill_counters", "SELECT count(*) AS total, count(*) FILTER (id % 4 = 0) AS updated, count(*) FILTER (id % 4 = 1) AS failed, count(*) FILTER (id % 4 > 1) AS skipped FROM posts WHERE NOT dirty AND NOT deleted", "posts")
def backfill_counters(spark, d):
    rows = v.posts(spark, d).where("NOT dirty AND NOT deleted").select(F.when(F.col("id") % 4 == 0, "updated").when(F.col("id") % 4 == 1, "failed").otherwise("skipped").alias("status"))
    return stats.batch_counters(rows)


@query("job_rate_eta", "SELECT id, rate, CAST(CASE WHEN progress = 0 OR elapsed <= 0 THEN -1 WHEN total - progress > 0 AND rate > 0 THEN ceil((total - progress) / rate) WHEN total - progress <= 0 THEN 0 ELSE -1 END AS INT) AS eta FROM (SELECT *, CASE WHEN progress = 0 OR elapsed <= 0 THEN 0 ELSE round(progress / elapsed * 100) / 100 END::DOUBLE AS rate FROM jobs)", "jobs")
def job_rate_eta(spark, d):
    progress, total, elapsed = F.col("progress"), F.col("total"), F.col("elapsed")
    return v.jobs(spark, d).select("id", jobs.rate(progress, elapsed).alias("rate"), jobs.eta(progress, total, elapsed).alias("eta"))


@query("job_visibility", "SELECT id, visibility FROM jobs WHERE visibility = 'global' OR (visibility = 'user' AND owner_user_id = 3) OR (visibility = 'role' AND min_role_level <= 5)", "jobs")
def job_visibility(spark, d):
    return jobs.newest_first(v.jobs(spark, d).where(jobs.visible_to(USER, 5))).select("id", "visibility")


@query("job_running", "SELECT id, status IN ('running', 'pending') AS running FROM jobs", "jobs")
def job_running(spark, d):
    return v.jobs(spark, d).select("id", jobs.running(F.col("status")).alias("running"))


@query("job_ttl", "SELECT id FROM jobs WHERE status NOT IN ('done', 'failed') OR created_at > (SELECT max(created_at) FROM jobs) - INTERVAL 30 MINUTES", "jobs")
def job_ttl(spark, d):
    rows = v.jobs(spark, d)
    now = str(rows.agg(F.max("created_at")).first()[0])  # one value
    return jobs.unexpired(rows.withColumn("finished_at", F.when(F.col("status").isin("done", "failed"), F.col("created_at"))), now).select("id")


def _unit(seconds: int, name: str) -> str:
    return f"(s // {seconds}) || ' {name}' || CASE WHEN s // {seconds} <> 1 THEN 's' ELSE '' END || ' ago'"


@query("format_time_ago", f"SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s // 60 < 60 THEN (s // 60) || ' min ago' WHEN s // 3600 < 24 THEN {_unit(3600, 'hour')} WHEN s // 86400 < 30 THEN {_unit(86400, 'day')} WHEN s // 2592000 < 12 THEN {_unit(2592000, 'month')} ELSE {_unit(31104000, 'year')} END AS ago FROM (SELECT event_id, CAST(floor(epoch(ts + to_seconds(event_id * event_id * 37))) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)")
def format_time_ago(spark, d):
    """From seconds to years between two times: the later ones as seconds, for timestamps end before the last of them."""
    then, key = F.unix_timestamp(F.col("ts").cast("timestamp")), F.col("event_id")
    return v.table(spark, d, "events").select("event_id", text.seconds_ago(then + key * key * 37 - then).alias("ago"))


@query("format_bytes", "SELECT doc_id, CASE WHEN b = 0 THEN '0 B' ELSE printf('%.1f', floor(b / pow(1024, i) * 10 + 0.5) / 10) || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][i + 1] END AS size FROM (SELECT doc_id, b, CASE WHEN b >= pow(1024, 4) THEN 4 WHEN b >= pow(1024, 3) THEN 3 WHEN b >= 1048576 THEN 2 WHEN b >= 1024 THEN 1 ELSE 0 END AS i FROM (SELECT doc_id, n_chars * pow(37, doc_id % 8)::BIGINT * (doc_id % 9)::BIGINT AS b FROM documents))")
def format_bytes(spark, d):
    n = F.col("n_chars") * F.pow(F.lit(37), F.col("doc_id") % 8).cast("long") * (F.col("doc_id") % 9)
    return v.table(spark, d, "documents").select("doc_id", text.format_bytes(n).alias("size"))


@query("format_duration", "SELECT doc_id, CASE WHEN n_chars < 60 THEN n_chars || 's' WHEN n_chars < 3600 THEN (n_chars // 60) || 'm ' || (n_chars % 60) || 's' ELSE (n_chars // 3600) || 'h ' || (n_chars // 60 % 60) || 'm' END AS took FROM documents")
def format_duration(spark, d):
    return v.table(spark, d, "documents").select("doc_id", text.format_duration(F.col("n_chars")).alias("took"))


@query("role_name", "SELECT id, CASE level WHEN 10 THEN 'admin' WHEN 5 THEN 'secret' WHEN 1 THEN 'member' ELSE 'guest' END AS role, CASE WHEN level >= 5 THEN 'sfw,nsfp,nsfw,secret' WHEN level >= 1 THEN 'sfw,nsfp,nsfw' ELSE 'sfw' END AS options FROM users", "users")
def role_name(spark, d):
    return v.users(spark, d).select("id", labels.role_name(F.col("level")).alias("role"), F.array_join(labels.filter_options(F.col("level")), ",").alias("options"))


@query("scaled_dimensions", "SELECT id, CASE WHEN w = 0 OR h = 0 THEN 0 WHEN m = 0 OR w <= m THEN w - w % 2 ELSE m - m % 2 END::INT AS width, CASE WHEN w = 0 OR h = 0 THEN 0 WHEN m = 0 OR w <= m THEN h - h % 2 ELSE round(h * (m / w))::INT - round(h * (m / w))::INT % 2 END::INT AS height FROM (SELECT id, (id % 1900)::INT AS w, (id % 1300)::INT AS h, CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN 920 ELSE 101 END AS m FROM posts)", "posts")
def scaled_dimensions(spark, d):
    """Unknown sides, no limit, an even limit and an odd one."""
    most = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, 920).otherwise(101)
    s = text.scaled((F.col("id") % 1900).cast("int"), (F.col("id") % 1300).cast("int"), most)
    return v.posts(spark, d).select("id", s["width"].alias("width"), s["height"].alias("height"))


# Integrity

@query("integrity_unique", "SELECT post_id, tag_id, count(*) AS n FROM post_tags GROUP BY post_id, tag_id HAVING count(*) > 1", "post_tags")
def integrity_unique(spark, d):
    return integrity.repeated_keys(v.post_tags(spark, d), ["post_id", "tag_id"])


@query("integrity_fk", "SELECT id, parent_id FROM (SELECT * FROM comments WHERE id % 3 <> 0) c WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM comments p WHERE p.id % 3 <> 0 AND p.id = c.parent_id)", "comments")
def integrity_fk(spark, d):
    c = v.comments(spark, d).where("id % 3 <> 0")
    return integrity.orphans(c.select("id", "parent_id"), "parent_id", c).select("id", "parent_id")


@query("integrity_check", "SELECT id, label FROM (SELECT id, CASE WHEN id % 97 = 0 THEN 'other' ELSE label END AS label FROM posts) WHERE label NOT IN ('sfw', 'nsfp', 'nsfw', 'secret')", "posts")
def integrity_check(spark, d):
    p = v.posts(spark, d).withColumn("label", F.when(F.col("id") % 97 == 0, "other").otherwise(F.col("label")))
    return integrity.unknown_labels(p).select("id", "label")


# Changes of tables

@query("dml_insert", "SELECT id, name, level FROM users UNION ALL SELECT (SELECT max(id) FROM users) + row_number() OVER (ORDER BY o_orderkey), 'new' || o_orderkey, 1 FROM orders", "users")
def dml_insert(spark, d):
    new = v.table(spark, d, "orders").select(F.concat(F.lit("new"), F.col("o_orderkey").cast("string")).alias("name"), F.lit(1).alias("level"), F.col("o_orderkey").alias("_order"))
    return mutate.inserted(v.users(spark, d), new, "_order")


@query("dml_upsert_tag", "SELECT id, name FROM named_tags UNION ALL SELECT (SELECT max(id) FROM named_tags) + row_number() OVER (ORDER BY k), name FROM (SELECT 'tag' || o_orderkey % 1007 AS name, min(o_orderkey) AS k FROM orders GROUP BY 1)", "named_tags")
def dml_upsert_tag(spark, d):
    names = v.table(spark, d, "orders").select(F.concat(F.lit("tag"), (F.col("o_orderkey") % 1007).cast("string")).alias("name"), F.col("o_orderkey").alias("k"))
    old = v.named_tags(spark, d)
    return mutate.tags_upserted(old, names.unionByName(old.select("name", F.lit(0).cast("long").alias("k"))), "k")


@query("dml_soft_delete", "SELECT id, deleted OR id % 10 = 0 AS deleted FROM posts", "posts")
def dml_soft_delete(spark, d):
    p = v.posts(spark, d)
    return mutate.soft_deleted(p, p.where("id % 10 = 0").select("id")).select("id", "deleted")


@query("dml_finalize", "SELECT id, CASE WHEN id % 2 = 0 THEN false ELSE dirty END AS dirty, CASE WHEN id % 2 = 0 THEN 'f' || id || '.avif' END AS filename, CASE WHEN id % 2 = 0 THEN 't' || id || '.avif' END AS thumbnail_filename, CASE WHEN id % 2 = 0 THEN '' END AS uploaded_filename, CASE WHEN id % 2 = 0 THEN 'image' END AS content_type, CASE WHEN id % 2 = 0 THEN id * 3 END::BIGINT AS p_hash_0, CASE WHEN id % 2 = 0 THEN -id END::BIGINT AS p_hash_3, CASE WHEN id % 2 = 0 THEN 640 ELSE 0 END AS width, CASE WHEN id % 2 = 0 THEN 480 ELSE 0 END AS height FROM posts", "posts")
def dml_finalize(spark, d):
    p = v.posts(spark, d)
    none = {c: F.lit(None).cast("string") for c in ("filename", "thumbnail_filename", "uploaded_filename", "content_type")} | {f"p_hash_{k}": F.lit(None).cast("long") for k in range(4)}
    key, text_key = F.col("id"), F.col("id").cast("string")
    done = p.where("id % 2 = 0").select("id", F.concat(F.lit("f"), text_key, F.lit(".avif")).alias("filename"), F.concat(F.lit("t"), text_key, F.lit(".avif")).alias("thumbnail_filename"), F.lit("").alias("uploaded_filename"), F.lit("image").alias("content_type"), (key * 3).cast("long").alias("p_hash_0"), *[F.lit(0).cast("long").alias(f"p_hash_{k}") for k in (1, 2)], (-key).cast("long").alias("p_hash_3"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    return mutate.finalized(p.withColumns(none | {"width": F.lit(0), "height": F.lit(0)}), done).select("id", "dirty", "filename", "thumbnail_filename", "uploaded_filename", "content_type", "p_hash_0", "p_hash_3", "width", "height")


@query("dml_delete_dirty", "SELECT id FROM posts WHERE NOT (dirty AND id % 2 = 0)", "posts")
def dml_delete_dirty(spark, d):
    p = v.posts(spark, d)
    return mutate.unfinished_deleted(p, p.where("id % 2 = 0").select("id")).select("id")


@query("dml_mark_read", "SELECT id, is_read OR (to_id = 3 AND from_id = 5) AS is_read FROM messages", "messages")
def dml_mark_read(spark, d):
    return messages.marked_read(v.messages(spark, d), USER, partner=5).select("id", "is_read")


@query("dml_mark_all_read", "SELECT id, is_read OR to_id = 3 AS is_read FROM messages", "messages")
def dml_mark_all_read(spark, d):
    return messages.marked_read(v.messages(spark, d), USER).select("id", "is_read")


@query("dml_cascade", "SELECT c.id, c.post_id, CASE WHEN (c.parent_id // 100) % 5 <> 0 THEN c.parent_id END AS parent_id FROM comments c WHERE c.post_id % 5 <> 0", "comments")
def dml_cascade(spark, d):
    kept = v.comments(spark, d).where("post_id % 5 <> 0").select(F.col("post_id").alias("id")).distinct()
    return mutate.comments_cascaded(v.comments(spark, d), kept).select("id", "post_id", "parent_id")


@query("dml_delete_tag", """SELECT 'tags' AS tbl, id, name AS what FROM tags WHERE id <> 17 UNION ALL SELECT 'post_tags', id, CAST(tag_id AS VARCHAR) FROM post_tags WHERE tag_id <> 17
    UNION ALL SELECT 'tag_votes', entity, CAST(user_id AS VARCHAR) FROM (SELECT id AS entity, post_id % 7 AS user_id FROM post_tags WHERE score > 25) WHERE entity NOT IN (SELECT id FROM post_tags WHERE tag_id = 17)
    UNION ALL SELECT 'posts', id, CASE WHEN id IN (SELECT post_id FROM post_tags WHERE tag_id = 17) THEN 'sfw' ELSE label END FROM posts""", "tags", "post_tags", "posts")
def dml_delete_tag(spark, d):
    """All four tables after a tag is gone. None of the tags is a keyword, so its posts fall back to sfw."""
    links = v.post_tags(spark, d)
    votes_ = links.where("score > 25").select(F.col("id").alias("entity"), (F.col("post_id") % 7).alias("user_id"))
    out = mutate.tag_deleted(17, v.tags(spark, d), links, votes_, v.posts(spark, d))
    part = lambda name, key, what: out[name].select(F.lit(name).alias("tbl"), F.col(key).cast("long").alias("id"), F.col(what).cast("string").alias("what"))
    return part("tags", "id", "name").unionByName(part("post_tags", "id", "tag_id")).unionByName(part("tag_votes", "entity", "user_id")).unionByName(part("posts", "id", "label"))


@query("dml_ensure_admin", "SELECT id, name, CASE WHEN id = 5 THEN greatest(level, 10) ELSE level END AS level FROM users", "users")
def dml_ensure_admin(spark, d):
    users = v.users(spark, d)
    name = users.where("id = 5").first()["name"]  # one row
    return mutate.admin_ensured(users, name)


@query("dml_invitation", "SELECT id, CASE WHEN id = 12 THEN 3 WHEN id % 2 = 1 THEN 99 END AS used_by, CASE WHEN id = 12 THEN 'ok' WHEN id = 13 THEN 'used' END AS status FROM users UNION ALL SELECT -1, NULL, 'not_found'", "users")
def dml_invitation(spark, d):
    """The table after a free token was used, and what the same does for it, for a used one and for one that isn't there."""
    inv = v.users(spark, d).select("id", F.col("id").cast("string").alias("token"), F.when(F.col("id") % 2 == 1, F.lit(99)).alias("used_by"), F.lit(None).cast("timestamp_ntz").alias("used_at"))
    tried = [mutate.invitation_used(inv, token, USER, F.lit(NOW).cast("timestamp_ntz")) for token in ("12", "13", "none")]
    after = tried[0][0].select("id", "used_by")
    told = None
    for key, (_, status) in zip((12, 13, -1), tried, strict=True):
        one = status.select(F.lit(key).cast("long").alias("_id"), "status")
        told = one if told is None else told.unionByName(one)
    return after.join(told, after["id"] == told["_id"], "full").select(F.coalesce("id", "_id").alias("id"), "used_by", "status")


@query("dml_release", "SELECT id, CASE WHEN deleted THEN 'not_found' WHEN user_id <> asker THEN 'forbidden' WHEN dirty THEN 'unfinished' WHEN released THEN 'already' ELSE 'ok' END AS status FROM (SELECT *, CASE WHEN id % 4 = 0 THEN -1 ELSE user_id END AS asker FROM posts)", "posts")
def dml_release(spark, d):
    asked = v.posts(spark, d).select("id", F.when(F.col("id") % 4 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("user_id"), F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("tags"))
    return mutate.released(v.posts(spark, d), asked).select("id", "status")


@query("dml_rescore", "SELECT p.id, coalesce(s.score, p.score) AS score FROM posts p LEFT JOIN (SELECT entity, CAST(sum(vote) AS BIGINT) AS score FROM (SELECT entity, user_id, arg_max(vote, seq) AS vote FROM votes GROUP BY entity, user_id) GROUP BY entity) s ON s.entity = p.id", "posts", "votes")
def dml_rescore(spark, d):
    return votes.rescored(v.posts(spark, d), votes.scores(v.votes(spark, d))).select("id", "score")


from larkspan.plans import records, values  # noqa: E402, F401  register the rest
from larkspan.plans import stores, streams  # noqa: E402, F401, I001  after what they take over
