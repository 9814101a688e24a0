"""More registered queries: values that clients and servers make, pictures, records as text, and life cycles from logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from larkspan.functions import kernels, text
from larkspan.operators import feed, jobs, messages, mutate, tagging
from larkspan.plans import views as v
from larkspan.plans.registry import USER, query
from larkspan.sources import feeds, frames
from larkspan.sources.scratch import folder


def _one_of(key: F.Column, values: list) -> F.Column:
    """values[key % number of values]."""
    return F.element_at(F.array(*[x if isinstance(x, F.Column) else F.lit(x) for x in values]), (key % len(values) + 1).cast("int"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + "]"


# Words that people enter

EMAILS = ["a@b.de", "a b@c.de", "x", "@b.de", "a@-b.de", "a@b-.de", "o'neil+tag@mail.example.org", "a@b", "ä@b.de", "a@b..de", "", "a" * 250 + "@b.de", "a" * 249 + "@b.d"]


@query("valid_accounts", f"SELECT c_custkey, e AS email, strlen(e) BETWEEN 3 AND 254 AND regexp_full_match(e, '[a-zA-Z0-9.!#$%&''*+/=?^_`{{|}}~-]+@[a-zA-Z0-9]([a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?([.][a-zA-Z0-9]([a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?)*') AS email_ok, strlen(n) >= 4 AS name_ok FROM (SELECT c_custkey, {_sql_list(EMAILS)}[c_custkey % {len(EMAILS)} + 1] AS e, ['abc', 'abcd', 'äb', 'äöü', ''][c_custkey % 5 + 1] AS n FROM customer)")
def valid_accounts(spark, d):
    key = F.col("c_custkey")
    email, name = _one_of(key, EMAILS), _one_of(key, ["abc", "abcd", "äb", "äöü", ""])
    return v.table(spark, d, "customer").select("c_custkey", email.alias("email"), text.valid_email(email).alias("email_ok"), text.valid_name(name).alias("name_ok"))


NUMBERS = ["7", "0", "-3", "x", "", " 7", "+7", "7.5", "12345678901", "1e3", "99999999999999999999"]


@query("page_numbers", f"SELECT event_id, CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') AND TRY_CAST(t AS BIGINT) >= 1 THEN TRY_CAST(t AS BIGINT) ELSE 20 END AS page FROM (SELECT event_id, {_sql_list(NUMBERS)}[event_id % {len(NUMBERS)} + 1] AS t FROM events)")
def page_numbers(spark, d):
    return v.table(spark, d, "events").select("event_id", text.page_number(_one_of(F.col("event_id"), NUMBERS), 20).alias("page"))


BOXES = ["cat dog", "cat User:bob dog", "user:x", "", "user: y", "xuser:eve", "a  user:b   c", "user:b user:c d"]


@query("search_boxes", f"SELECT event_id, nullif(regexp_extract(t, '(?i)(?:^|\\s)user:(\\S+)', 1), '') AS user_name, array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(t, '(?i)(?:^|\\s)user:\\S+', ' ', 'g')), '\\s+'), lambda x: x <> ''), ',') AS tags FROM (SELECT event_id, {_sql_list(BOXES)}[event_id % {len(BOXES)} + 1] AS t FROM events)")
def search_boxes(spark, d):
    box = _one_of(F.col("event_id"), BOXES)
    return v.table(spark, d, "events").select("event_id", text.search_user(box).alias("user_name"), F.array_join(text.search_tags(box), ",").alias("tags"))


LINKS = ["https://a.b/c.webm?x=1", "https://a.b/c", "HTTP://A.B/C.JPEG", "ftp://a.b/c.png", "https://a b/c.png", "https://a.b/c.tif", "https://a.b/c.jxl", "see https://a.b/c.png", "https://.png", ""]


@query("media_links", f"SELECT event_id, regexp_matches(t, '(?i)^https?://.+[.](jpe?g|png|gif|webp|avif|bmp|tiff?|svg|mp4|webm|mov|avi|mkv)([?].*)?$') AS media FROM (SELECT event_id, {_sql_list(LINKS)}[event_id % {len(LINKS)} + 1] AS t FROM events)")
def media_links(spark, d):
    return v.table(spark, d, "events").select("event_id", text.media_url(_one_of(F.col("event_id"), LINKS)).alias("media"))


@query("feed_addresses", "SELECT c_custkey, 'https://feed.example/items?tags=' || replace(replace(c_name, '#', '%23'), ' ', '+') || '&older=' || c_custkey AS url, 'older=' || c_custkey AS parsed FROM customer")
def feed_addresses(spark, d):
    """Addresses of feed pages, put together and read again."""
    url = F.concat(F.lit("https://feed.example/items?tags="), F.url_encode("c_name"), F.lit("&older="), F.col("c_custkey").cast("string"))
    older = F.parse_url(url, F.lit("QUERY"), F.lit("older"))
    return v.table(spark, d, "customer").select("c_custkey", url.alias("url"), F.concat(F.lit("older="), older).alias("parsed"))


# What clients show

@query("client_values", """SELECT event_id, CASE WHEN total > 0 THEN floor(done * 100 / total + 0.5) WHEN running THEN 0 ELSE 100 END::INT AS percent, CASE WHEN old = clicked THEN 0 ELSE clicked END AS vote, (score + CASE WHEN event_id % 5 = 0 THEN 0 ELSE CASE WHEN old = clicked THEN 0 ELSE clicked END - old END)::BIGINT AS score, greatest(2, w // 154)::INT AS grid, least(depth, 8) * 16 AS indent,
    CASE WHEN event_id % 4 = 0 THEN '/images/thumbnails/t.avif' WHEN event_id % 4 < 3 THEN '/images/thumbnails/f.mov' END AS thumb, event_id % 3 = 0 OR event_id % 4 < 3 AS video
    FROM (SELECT *, event_id % 4 AS total, event_id % 7 % (event_id % 4 + 1) AS done, event_id % 2 = 0 AS running, (event_id % 3 - 1)::INT AS old, (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END)::INT AS clicked, event_id * 7 AS score, (event_id * 13 % 2000)::INT AS w, (event_id % 12)::INT AS depth FROM events)""")
def client_values(spark, d):
    key = F.col("event_id")
    total, done = key % 4, key % 7 % (key % 4 + 1)
    old, clicked = (key % 3 - 1).cast("int"), F.when(key % 2 == 0, 1).otherwise(-1)
    vote = text.toggled(old, clicked)
    thumb, name = F.when(key % 4 == 0, "t.avif").when(key % 4 == 1, ""), F.when(key % 4 < 3, "f.mov").otherwise("")
    kind = F.when(key % 3 == 0, "video/mp4").when(key % 3 == 1, "image")
    return v.table(spark, d, "events").select(
        "event_id", text.progress_percent(done, total, key % 2 == 0).alias("percent"), vote.alias("vote"), text.optimistic(key * 7, old, vote, key % 5 != 0).alias("score"), text.grid_columns((key * 13 % 2000).cast("int")).alias("grid"),
        text.indent((key % 12).cast("int")).alias("indent"), text.thumbnail_url(thumb, name).alias("thumb"), text.is_video(kind, name).alias("video"),
    )


@query("log_previews", "SELECT doc_id, CASE WHEN strlen(text) > 200 THEN left(text, (SELECT max(n)::INT FROM (SELECT unnest(generate_series(0, 200)) AS n) WHERE strlen(left(text, n::INT)) <= 200)) || '[…]' ELSE text END AS preview FROM documents")
def log_previews(spark, d):
    return v.table(spark, d, "documents").select("doc_id", text.log_preview(F.col("text"), 200).alias("preview"))


PROBES = ["640,480", "x", "640", ",480", "640,x", "640,480,1", "", "-1,2"]


@query("probed_sizes", f"SELECT event_id, coalesce(TRY_CAST(string_split(t, ',')[1] AS INT), 0) AS width, coalesce(TRY_CAST(string_split(t, ',')[2] AS INT), 0) AS height FROM (SELECT event_id, CASE WHEN contains(x, ',') THEN x ELSE '' END AS t FROM (SELECT event_id, {_sql_list(PROBES)}[event_id % {len(PROBES)} + 1] AS x FROM events))")
def probed_sizes(spark, d):
    size = text.dimensions(_one_of(F.col("event_id"), PROBES))
    return v.table(spark, d, "events").select("event_id", size["width"].alias("width"), size["height"].alias("height"))


@query("retry_delays", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 90 ELSE least(pow(2, event_id % 9 + 1), 60) END::DOUBLE AS seconds FROM events")
def retry_delays(spark, d):
    key = F.col("event_id")
    return v.table(spark, d, "events").select("event_id", text.retry_delay(key % 9, F.when(key % 3 == 0, (key % 90).cast("int"))).alias("seconds"))


@query("full_page_guess", "SELECT (SELECT count(*) FROM (SELECT 1 FROM messages WHERE to_id = 3 AND kind <> 'private' LIMIT 20)) = 20 AS has_more UNION ALL SELECT (SELECT count(*) FROM (SELECT 1 FROM messages WHERE to_id = 3 AND kind <> 'private' LIMIT 2)) = 2", "messages")
def full_page_guess(spark, d):
    rows = v.messages(spark, d), v.posts(spark, d), v.comments(spark, d)
    guess = lambda n: feed.full_page(messages.notifications(*rows, USER, limit=n), n)
    return guess(20).unionByName(guess(2))


# Conversations

CONVERSATIONS = "SELECT partner, max(created_at) AS last_at, arg_max(body, (created_at, id)) AS last_body, count(*) FILTER (to_id = 3 AND NOT is_read) AS unread FROM (SELECT *, CASE WHEN from_id = 3 THEN to_id ELSE from_id END AS partner FROM messages WHERE kind = 'private' AND (from_id = 3 OR to_id = 3)) GROUP BY partner"


@query("conversation_sent", f"SELECT partner, last_at, last_body, unread FROM ({CONVERSATIONS}) WHERE partner <> (SELECT min(partner) FROM ({CONVERSATIONS})) UNION ALL SELECT partner, TIMESTAMP '2030-01-01', 'Hi', unread FROM ({CONVERSATIONS}) WHERE partner = (SELECT min(partner) FROM ({CONVERSATIONS})) UNION ALL SELECT -5, TIMESTAMP '2030-01-01', 'Hi', 0", "messages")
def conversation_sent(spark, d):
    """A message to an old partner, and one to a new one."""
    mine = messages.inbox(v.messages(spark, d), USER).drop("last_id")
    old = mine.agg(F.min("partner").alias("partner"))
    to = old.unionByName(spark.range(1).select(F.lit(-5).cast("long").alias("partner")))
    return messages.sent(mine, to.select("partner", F.lit("2030-01-01").cast("timestamp_ntz").alias("created_at"), F.lit("Hi").alias("body")))


@query("conversation_opened", f"WITH messages AS ({v.SQL['messages']}), c AS ({CONVERSATIONS}), o AS (SELECT min(partner) AS p FROM c WHERE unread > 0) SELECT partner, CASE WHEN partner = (SELECT p FROM o) THEN 0 ELSE unread END AS unread, greatest(0, (SELECT sum(unread) FROM c) - coalesce((SELECT unread FROM c WHERE partner = (SELECT p FROM o)), 0))::BIGINT AS total_unread FROM c")
def conversation_opened(spark, d):
    mine = messages.inbox(v.messages(spark, d), USER)
    told = mine.agg(F.sum("unread").alias("all"), F.min(F.when(F.col("unread") > 0, F.col("partner"))).alias("first")).first()  # one row
    return messages.opened(mine, F.lit(told["all"]), told["first"]).select("partner", "unread", F.col("total_unread").cast("long").alias("total_unread"))


# Tags and posts

@query("live_tags", "SELECT id, name FROM tags", "tags")
def live_tags(spark, d):
    return v.tags(spark, d).orderBy("id")


@query("keyword_tags", "SELECT x.post_id, CASE x.tag_id % 40 WHEN 0 THEN 'nsfp' WHEN 1 THEN 'nsfw' ELSE 'secret' END AS name FROM post_tags x WHERE x.tag_id % 40 < 3", "post_tags")
def keyword_tags(spark, d):
    key = F.col("id")
    tags = v.tags(spark, d).withColumn("name", F.when(key % 40 == 0, "nsfp").when(key % 40 == 1, "nsfw").when(key % 40 == 2, "secret").otherwise(F.col("name")))
    return tagging.keyword_names(v.post_tags(spark, d), tags)


@query("dml_updates", "SELECT id, CASE WHEN id % 2 = 0 THEN 'secret' ELSE label END AS label, released OR id % 3 = 0 AS released, CASE WHEN id % 5 = 0 THEN 640 ELSE 0 END AS width, CASE WHEN id % 7 = 0 THEN 'f' || id ELSE '' END AS filename, CASE WHEN id % 11 = 0 THEN id ELSE 0 END::BIGINT AS p_hash_0 FROM posts", "posts")
def dml_updates(spark, d):
    """Changes of single columns, one after another."""
    p, key = v.posts(spark, d).withColumns({"width": F.lit(0), "filename": F.lit(""), "p_hash_0": F.lit(0).cast("long")}), F.col("id")
    steps = [(key % 2 == 0, {"label": F.lit("secret")}), (key % 3 == 0, {"released": F.lit(True)}), (key % 5 == 0, {"width": F.lit(640)}), (key % 7 == 0, {"filename": F.concat(F.lit("f"), key.cast("string"))}), (key % 11 == 0, {"p_hash_0": key.cast("long")})]
    return reduce(lambda rows, s: mutate.set_where(rows, s[0], **s[1]), steps, p).select("id", "label", "released", "width", "filename", "p_hash_0")


# Pictures: an embedding's 64 numbers as 8 x 8 gray pixels

GRAY = "SELECT vec_id, list_transform(embedding, lambda x: floor(x * 100)::BIGINT) AS g FROM embeddings"


@query("picture_energy", f"""WITH p AS ({GRAY}), s AS (SELECT vec_id, g, unnest([0, 2, 4, 6]) AS y FROM p), t AS (SELECT vec_id, g, y, unnest([0, 2, 4, 6]) AS x FROM s),
    n AS (SELECT vec_id, x, y, g, greatest(x - 1, 0) AS l, x + 1 AS r, greatest(y - 1, 0) AS u, y + 1 AS b FROM t),
    e AS (SELECT vec_id, x, y, pow((g[u * 8 + r + 1] + 2 * g[y * 8 + r + 1] + g[b * 8 + r + 1]) - (g[u * 8 + l + 1] + 2 * g[y * 8 + l + 1] + g[b * 8 + l + 1]), 2) + pow((g[b * 8 + l + 1] + 2 * g[b * 8 + x + 1] + g[b * 8 + r + 1]) - (g[u * 8 + l + 1] + 2 * g[u * 8 + x + 1] + g[u * 8 + r + 1]), 2) AS e FROM n),
    c AS (SELECT vec_id, cy, cx, sum(e) AS s FROM e, (SELECT unnest([0, 2, 4]) AS cy), (SELECT unnest([0, 2, 4]) AS cx) WHERE y >= cy AND y < cy + 4 AND x >= cx AND x < cx + 4 GROUP BY vec_id, cy, cx),
    w AS (SELECT vec_id, cx, cy FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cy, cx) = 1)
    SELECT vec_id, (SELECT sum(e) FROM e WHERE e.vec_id = w.vec_id)::BIGINT AS energy, cx::INT AS crop_x, cy::INT AS crop_y FROM w""")
def picture_energy(spark, d):
    gray = F.transform("embedding", lambda x: F.floor(x * F.lit(100).cast("float")))  # in the numbers' own width, as SQL multiplies: 0.29 is just below 29 hundredths in double
    return v.table(spark, d, "embeddings").select("vec_id", kernels.crop_of_gray(4)(gray).alias("c")).select("vec_id", "c.*")


def _gray(low: float = 0.0):
    return F.transform("embedding", lambda x: F.least(F.greatest(x.cast("double") * 100 + 128, F.lit(low)), F.lit(255.0)))


@query("picture_hashes")
def picture_hashes(spark, d):
    """Perceptual hashes of the same pictures; SQL can't resize. Tests hold them against plain loops over pixels."""
    rows = v.table(spark, d, "embeddings").select("vec_id", kernels.phash_of_gray(_gray()).alias("w"))
    return rows.select("vec_id", *[F.element_at("w", k + 1).alias(f"p_hash_{k}") for k in range(4)])


@query("picture_thumbnails")
def picture_thumbnails(spark, d):
    """The best 5 x 5 of each picture, shrunk to 3 x 3. Tests hold them against plain loops over pixels."""
    gray = F.transform(_gray(), lambda x: F.floor(x).cast("int"))
    return v.table(spark, d, "embeddings").select("vec_id", F.array_join(kernels.thumbnail_of_gray(8, 8, 3)(gray), ",").alias("pixels"))


@query("picture_facts")
def picture_facts(spark, d):
    """All that an import needs to know of each picture, as rows of Spark's image source. Tests hold it against hashes of the same pixels."""
    data = F.unhex(F.array_join(F.transform(_gray(), lambda x: F.lpad(F.hex(F.floor(x).cast("long")), 2, "0")), ""))
    image = F.struct(F.lit("").alias("origin"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), data.alias("data"))
    rows = v.table(spark, d, "embeddings").select("vec_id", kernels.picture_facts(image).alias("f"))
    return rows.select("vec_id", *[F.element_at("f.words", k + 1).alias(f"p_hash_{k}") for k in range(4)], "f.crop_x", "f.crop_y", "f.width", "f.height")


RGB = "SELECT vec_id, list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 1000)::BIGINT % 256) AS p FROM embeddings"


def _yuv_sql(full: bool) -> str:
    k = kernels.YUV[full]
    term = lambda c, r, g, b: f"least(greatest({c[3]} + ((({c[0]}) * ({r}) + ({c[1]}) * ({g}) + ({c[2]}) * ({b}) + 128) >> 8), 0), 255)"
    one = lambda c: f"p[3 * i + {c + 1}]"
    four = lambda c: f"(({' + '.join(f'p[3 * (8 * (i // 2) + 2 * (i % 2) + {o}) + {c + 1}]' for o in (0, 1, 4, 5))}) // 4)"
    luma = f"list_transform(generate_series(0, 15), lambda i: {term(k[0], one(0), one(1), one(2))})"
    chroma = [f"list_transform(generate_series(0, 3), lambda i: {term(c, four(0), four(1), four(2))})" for c in k[1:]]
    return f"SELECT vec_id, {full} AS full_range, " + ", ".join(f"array_to_string({x}, ',') AS {n}" for x, n in zip((luma, *chroma), "yuv", strict=True)) + " FROM p"


@query("picture_yuv", f"WITH p AS ({RGB}) {_yuv_sql(True)} UNION ALL {_yuv_sql(False)}")
def picture_yuv(spark, d):
    """The first 48 numbers as 4 x 4 pixels of three colours, as planes of brightness and colour, in full and in limited range."""
    rgb = F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 1000) % 256).cast("int"))
    rows = v.table(spark, d, "embeddings").select("vec_id", F.slice(rgb, 1, 48).alias("rgb"))
    both = [rows.select("vec_id", F.lit(full).alias("full_range"), kernels.yuv420(4, 4, full)(F.col("rgb")).alias("p")) for full in (True, False)]
    return both[0].unionByName(both[1]).select("vec_id", "full_range", *[F.array_join(f"p.{c}", ",").alias(c) for c in "yuv"])


# Records as text

@query("server_sent_events", "SELECT id, name FROM tags", "tags")
def server_sent_events(spark, d):
    """Tags as frames of an event stream with heartbeats, written by the committing sink and read again."""
    spark.dataSource.register(frames.FrameSink)
    path = folder(spark, "frames")
    value = F.when(F.col("id") % 7 == 0, F.concat("value", F.lit(frames.HEARTBEAT))).otherwise(F.col("value"))
    tags = v.tags(spark, d)
    told = tags.select("id", F.struct(*tags.columns).alias("row")).select("id", feeds.sse_frame(F.col("row")).alias("value"))
    told.select(value.alias("value")).write.format("event_frames").mode("append").save(path)
    return frames.events(spark, path, "id long, name string")


@query("queue_items", "SELECT event_id::INT AS post_id, 'f' || event_id AS filename, 't' AS thumbnail_filename, CASE WHEN event_id % 2 = 0 THEN 'job' ELSE '' END AS job_key FROM events WHERE event_id % 5 < 3")
def queue_items(spark, d):
    return feeds.queue_items(queue_records(spark, d))


def queue_records(spark, d):
    """Queue records of which some aren't JSON and some lack what they need."""
    key = F.col("event_id").cast("string")
    whole = F.concat(F.lit('{"post_id": '), key, F.lit(', "filename": "f'), key, F.lit('", "thumbnail_filename": "t"'), F.when(F.col("event_id") % 2 == 0, ', "job_key": "job"').otherwise(""), F.lit("}"))
    value = F.when(F.col("event_id") % 5 == 3, "nonsense").when(F.col("event_id") % 5 == 4, F.concat(F.lit('{"post_id": '), key, F.lit("}"))).otherwise(whole)
    return v.table(spark, d, "events").select(value.alias("value"))


@query("job_states", """WITH l AS (SELECT event_id // 6 AS job, event_id AS seq, ['start', 'total', 'add', CASE WHEN event_id // 6 % 4 = 0 THEN 'set' ELSE 'add' END, CASE event_id // 6 % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'cancel' ELSE 'add' END, CASE WHEN event_id // 6 % 3 = 0 THEN 'cancel' ELSE 'add' END][event_id % 6 + 1] AS kind, (event_id % 50)::BIGINT AS n FROM events WHERE event_id % 6 > 0 OR event_id // 6 % 7 > 0),
    f AS (SELECT job, min(seq) FILTER (kind IN ('done', 'failed', 'cancel')) AS ends, arg_min(kind, seq) FILTER (kind IN ('done', 'failed', 'cancel')) AS final, bool_or(kind = 'start') AS begun FROM l GROUP BY job),
    v AS (SELECT l.* FROM l JOIN f USING (job) WHERE ends IS NULL OR seq < ends),
    b AS (SELECT job, max(seq) FILTER (kind = 'set') AS since, arg_max(n, seq) FILTER (kind = 'set') AS base, arg_max(n, seq) FILTER (kind = 'total') AS total FROM v GROUP BY job)
    SELECT job, CASE WHEN final = 'cancel' THEN 'cancelled' WHEN final IS NOT NULL THEN final WHEN begun THEN 'running' ELSE 'pending' END AS status, (coalesce(base, 0) + coalesce((SELECT sum(n) FROM v WHERE v.job = f.job AND kind = 'add' AND (since IS NULL OR seq > since)), 0))::BIGINT AS progress, coalesce(total, 0)::BIGINT AS total FROM f LEFT JOIN b USING (job)""")
def job_states(spark, d):
    return jobs.states(job_log(v.table(spark, d, "events")).drop("ts"))


def job_log(events):
    """Six messages a job, some of them missing, some after its end."""
    key = F.col("event_id")
    job = F.floor(key / 6)
    kinds = ["start", "total", "add", F.when(job % 4 == 0, "set").otherwise("add"), F.when(job % 5 == 0, "done").when(job % 5 == 1, "failed").when(job % 5 == 2, "cancel").otherwise("add"), F.when(job % 3 == 0, "cancel").otherwise("add")]
    return events.where((key % 6 > 0) | (job % 7 > 0)).select(job.alias("job"), key.alias("seq"), "ts", _one_of(key, kinds).alias("kind"), (key % 50).cast("long").alias("n"))
