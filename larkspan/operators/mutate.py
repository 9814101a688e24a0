"""Changes to tables as functions: the old table (and changes) in, the new table out.

Plain Parquet has no UPDATE; `sources.snapshots` swaps the new table in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.labels import of_level
from larkspan.operators.feed import ranked, summed_before
from larkspan.operators.tagging import KEYWORDS, keyword_names, relabelled
from larkspan.sources.scratch import settled


def set_where(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    """rows with columns set where the condition holds (null counts as not)."""
    hit = F.coalesce(where, F.lit(False))
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def inserted(rows: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """rows and new ones with ids after the largest; new: the columns but id, and an integer `order` that numbers them."""
    top = rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    numbered = ranked(new, key=order, descending=False, name="_place").crossJoin(F.broadcast(top))
    made = numbered.withColumn("id", (F.col("_top") + F.col("_place") + 1).cast(rows.schema["id"].dataType)).select([c for c in rows.columns if c in numbered.columns or c == "id"])
    return rows.unionByName(made, allowMissingColumns=True)


def tags_upserted(tags: DataFrame, names: DataFrame, order: str) -> DataFrame:
    """tags and the names (name, order) that aren't there yet, each once."""
    fresh = names.join(tags, "name", "left_anti").groupBy("name").agg(F.min(order).alias(order))
    return inserted(tags, fresh, order)


def soft_deleted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return flagged(rows, ids, "deleted")


def flagged(rows: DataFrame, ids: DataFrame, column: str, value: bool = True) -> DataFrame:
    """rows with a boolean column set for the ids."""
    hit = ids.select(F.col("id").alias("_id")).distinct()
    return rows.join(hit, rows["id"] == hit["_id"], "left").withColumn(column, F.when(F.col("_id").isNotNull(), F.lit(value)).otherwise(F.col(column))).drop("_id")


#: What processing finds out about a post, beside its id.
RESULT = ["filename", "thumbnail_filename", "uploaded_filename", "content_type", "p_hash_0", "p_hash_1", "p_hash_2", "p_hash_3", "width", "height"]


def finalized(posts: DataFrame, results: DataFrame) -> DataFrame:
    """Posts with a result (id and the columns of RESULT that posts have) take it over and become finished."""
    columns = [c for c in RESULT if c in posts.columns]
    new = results.select(F.col("id").alias("_id"), F.struct(*columns).alias("_new"))
    joined = posts.join(new, posts["id"] == new["_id"], "left")
    hit = F.col("_id").isNotNull()
    return joined.withColumns({"dirty": F.col("dirty") & ~hit, **{c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in columns}}).drop("_id", "_new")


def unfinished_deleted(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """posts without the given ones that are still unfinished (finished ones stay)."""
    hit = ids.select(F.col("id").alias("_id")).distinct()
    return posts.join(hit, posts["id"] == hit["_id"], "left").where(F.col("_id").isNull() | ~F.col("dirty")).drop("_id")


def tag_deleted(tag: int, tags: DataFrame, post_tags: DataFrame, tag_votes: DataFrame, posts: DataFrame) -> dict[str, DataFrame]:
    """All four tables without a tag; the labels of the posts that had it follow from the tags that are left."""
    links = post_tags.where(F.col("tag_id") != tag)
    gone = post_tags.where(F.col("tag_id") == tag)
    left_tags = tags.where(F.col("id") != tag)
    touched = posts.join(gone.select(F.col("post_id").alias("id")).distinct(), "id", "left_semi")
    others = posts.join(gone.select(F.col("post_id").alias("id")).distinct(), "id", "left_anti")
    return {"tags": left_tags, "post_tags": links, "tag_votes": tag_votes.join(gone.select(F.col("id").alias("entity")), "entity", "left_anti"), "posts": others.unionByName(relabelled(touched, keyword_names(links, left_tags)).select(posts.columns))}


def tag_removed(post: int, tag: int, post_tags: DataFrame, tag_votes: DataFrame, tags: DataFrame, posts: DataFrame) -> dict[str, DataFrame]:
    """A tag taken off one post: its link and the votes on it go, and the post's label follows from the tags that are left."""
    mine = (F.col("post_id") == post) & (F.col("tag_id") == tag)
    gone, links = post_tags.where(mine).select(F.col("id").alias("entity")), post_tags.where(~mine)
    touched = relabelled(posts.where(F.col("id") == post), keyword_names(links, tags))
    return {"post_tags": links, "tag_votes": tag_votes.join(gone, "entity", "left_anti"), "posts": posts.where(F.col("id") != post).unionByName(touched.select(posts.columns))}


#: Rows of the larger table that a task of a join takes, about.
ROWS_A_TASK = 1 << 20


def met(rows: DataFrame, key: str, ids: DataFrame, how: str, tasks: int) -> DataFrame:
    """rows joined by a key with the ids of a table (as `_id`). In more than one task, each hashes its ids; rows pass by unsorted, so their number and frequent keys take no memory."""
    ids = ids.select(F.col("id").alias("_id"))
    if tasks > 1:
        rows, ids = rows.repartition(tasks, key), ids.repartition(tasks, "_id").hint("shuffle_hash")
    return rows.join(ids, rows[key] == ids["_id"], how)


def comments_cascaded(comments: DataFrame, posts: DataFrame, tasks: int = 1, own_tasks: int = 1) -> DataFrame:
    """Comments of posts that exist; parents that don't become null. Comments meet posts in `tasks` tasks, and each other in own_tasks."""
    kept = met(comments, "post_id", posts, "left_semi", tasks)
    return met(kept, "parent_id", kept, "left", own_tasks).withColumn("parent_id", F.col("_id")).select(comments.columns)


def cascaded(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables after rows of posts, comments, tags or users are gone: what belongs to them goes too.

    tables: posts, comments, tags, users, post_tags (id, post_id, tag_id, user_id), post_votes, comment_votes and tag_votes (entity, user_id), messages
    (ref_post_id, ref_comment_id: references to what is gone become null). A tag's user that is gone leaves the tag where it is.
    """
    counts = reduce(DataFrame.unionByName, [t.agg(F.lit(k).alias("name"), F.count(F.lit(1)).alias("n")) for k, t in tables.items()])
    sizes = {r["name"]: r["n"] for r in counts.collect()}  # a row for each table
    tasks = lambda *names: max(sizes[k] for k in names) // ROWS_A_TASK + 1
    ids = {k: tables[k].select("id") for k in ("posts", "comments", "tags", "users")}
    of = lambda name, rows, key, parent: met(rows, key, ids[parent], "left_semi", tasks(name, parent))
    out = dict(tables)
    out["comments"] = comments_cascaded(tables["comments"], tables["posts"], tasks("comments", "posts"), tasks("comments"))
    ids["comments"] = out["comments"].select("id")
    out["post_tags"] = of("post_tags", of("post_tags", tables["post_tags"], "post_id", "posts"), "tag_id", "tags")
    ids["post_tags"] = out["post_tags"].select("id")
    for votes, parent in (("post_votes", "posts"), ("comment_votes", "comments"), ("tag_votes", "post_tags")):
        out[votes] = of(votes, of(votes, tables[votes], "entity", parent), "user_id", "users")
    messages = tables["messages"]
    for key, parent in (("ref_post_id", "posts"), ("ref_comment_id", "comments")):
        messages = met(messages, key, ids[parent], "left", tasks("messages", parent)).withColumn(key, F.col("_id").cast(messages.schema[key].dataType)).drop("_id")
    out["messages"] = messages.select(tables["messages"].columns)
    return out


def admin_ensured(users: DataFrame, name: str) -> DataFrame:
    """The named user gets level 10 at least; inserted if missing."""
    raised = set_where(users, F.col("name") == name, level=F.greatest("level", F.lit(10)))
    one = users.sparkSession.range(1).select(F.lit(name).alias("name"), F.lit(10).alias("level"), F.lit(0).alias("_order"))
    return inserted(raised, one.join(users.select("name"), "name", "left_anti"), "_order")


def labels_by_level(posts: DataFrame, level: str) -> DataFrame:
    return posts.withColumn("label", of_level(F.col(level)))


def invitation_used(invitations: DataFrame, token: str, user: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """The table after a token was used, if it was free; and one row with what happened: ok, used or not_found."""
    mine = F.col("token") == token
    after = set_where(invitations, mine & F.col("used_by").isNull(), used_by=F.lit(user), used_at=now)
    status = F.when(F.count_if(mine) == 0, "not_found").when(F.count_if(mine & F.col("used_by").isNull()) > 0, "ok").otherwise("used")
    return after, invitations.agg(status.alias("status"))


def released(posts: DataFrame, requests: DataFrame) -> DataFrame:
    """What becomes of requests (id, user_id, tags) to release posts: status, and the tags that would be added, each once.

    not_found (or deleted), forbidden (another's), unfinished, already, ok: all or nothing. Tags lose white space at both ends; empty ones don't count.
    """
    about = posts.select(F.col("id").alias("_id"), F.col("user_id").alias("_owner"), "dirty", "released", "deleted")
    joined = requests.join(about, requests["id"] == about["_id"], "left")
    status = F.when(F.col("_id").isNull() | F.col("deleted"), "not_found").when(F.col("_owner") != F.col("user_id"), "forbidden").when(F.col("dirty"), "unfinished").when(F.col("released"), "already").otherwise("ok")
    names = F.array_distinct(F.array_remove(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.trim(t)), ""))
    return joined.withColumn("status", status).select("id", "user_id", "status", F.when(F.col("status") == "ok", names).otherwise(F.array().cast("array<string>")).alias("tags"))


#: Tags of a name in one list, and posts that meet such a list in one task, about; and links that one task makes.
TAGS_AT_ONCE, POSTS_AT_ONCE, LINKS_A_TASK = 4096, 4096, 1 << 22


def links_by_name(named: DataFrame, tags: DataFrame, post_tags: DataFrame) -> DataFrame:
    """The links (id, post_id, tag_id, and the columns of named) from posts to all tags of a wanted name (named: post_id, name and others) that post_tags hasn't, with ids after its largest.

    There may be far more links than posts and tags: only runs of tags between a post's own ones are sorted, numbered and written,
    by lists of a name's tags; links are made as they are read, and what named has is only copied into them.
    """
    about = [c for c in named.columns if c not in ("post_id", "name")]
    spread = lambda key, ways: F.pmod(F.xxhash64(key), F.col(ways)).cast("int")
    wanted = named.groupBy("name").agg(F.ceil(F.count(F.lit(1)) / POSTS_AT_ONCE).cast("int").alias("lanes"))
    sizes = tags.select("name").join(wanted, "name").groupBy("name", "lanes").agg(F.ceil(F.count(F.lit(1)) / TAGS_AT_ONCE).cast("int").alias("ways"))
    lists = tags.join(settled(sizes, "names"), "name").groupBy("name", "lanes", spread("id", "ways").alias("list")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    lists = settled(lists, "tag-lists")
    places = lists.select("name", "list", F.posexplode("ids").alias("place", "tag_id"))
    own = post_tags.select("post_id", "tag_id").join(named.select("post_id").distinct(), "post_id", "left_semi").distinct()
    own = own.join(places, "tag_id").groupBy("post_id", "name", "list").agg(F.sort_array(F.collect_list("place")).alias("own"))
    lengths = lists.select("name", "list", "lanes", F.size("ids").alias("n"))
    runs = named.join(lengths, "name").join(own, ["post_id", "name", "list"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<int>")))
    edges = F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform("own", lambda p: p + 1)).alias("start"), F.concat("own", F.array("n")).alias("end"))
    runs = runs.withColumn("run", F.explode(edges)).select("post_id", *about, "name", "list", "lanes", F.col("run.start").alias("start"), (F.col("run.end") - F.col("run.start")).cast("long").alias("n")).where("n > 0")
    runs, total = summed_before(runs.withColumn("_order", F.xxhash64("post_id", "name", "list", "start")), "_order", "n", "before")
    tasks, meet = total // LINKS_A_TASK + 1, ["name", "list", "lane"]
    top = post_tags.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))  # one row
    left = runs.crossJoin(F.broadcast(top)).withColumn("lane", spread("post_id", "lanes")).select("post_id", *about, "start", "n", (F.col("top") + F.col("before") + 1).alias("first"), *meet)
    right = lists.select("name", "list", "ids", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"))
    met = left.repartition(tasks, *meet).join(right.repartition(tasks, *meet), meet)
    made = met.select("post_id", *about, "name", "first", F.posexplode(F.slice("ids", F.col("start") + 1, F.col("n").cast("int"))).alias("place", "tag_id"))
    return made.select((F.col("first") + F.col("place")).cast(post_tags.schema["id"].dataType).alias("id"), "post_id", "tag_id", *about, "name")


def release(requests: DataFrame, posts: DataFrame, tags: DataFrame, post_tags: DataFrame, comments: DataFrame, **about: Column) -> dict[str, DataFrame]:
    """The tables after requests (id, user_id, tags, comment; one for each post) to release posts, and each one's status.

    What `released` finds ok happens whole: missing tags are made, links from post to tag added where there are none, the label
    follows from the keywords among the tags if the request has one, a comment that isn't empty is written, and the post counts as released. Nothing
    happens for other requests. new_links has the added links alone, with the name that each was made for, and columns over post_id, user_id and name (about),
    worked out once for a post and a name: there may be far more links.
    """
    asked = settled(released(posts, requests), "released")
    fine = asked.where("status = 'ok'")
    named = fine.select(F.col("id").alias("post_id"), "user_id", F.explode("tags").alias("name"))
    new_tags = tags_upserted(tags, named.select("name", F.col("post_id").alias("_order")).groupBy("name").agg(F.min("_order").alias("_first")).select("name", F.xxhash64("name").alias("_order")), "_order")
    links = links_by_name(named.withColumns(about), new_tags, post_tags)
    new_links = post_tags.unionByName(links.withColumn("score", F.lit(0).cast(post_tags.schema["score"].dataType)).select(post_tags.columns))
    said = requests.join(fine.select("id"), "id", "left_semi").withColumn("content", F.trim("comment")).where("content <> ''")
    new_comments = inserted(comments, said.select(F.col("id").alias("post_id"), "user_id", "content", F.xxhash64("id").alias("_order")), "_order")
    keywords = named.where(F.col("name").isin(KEYWORDS)).select("post_id", "name")
    keyed = keywords.select(F.col("post_id").alias("id")).distinct()
    ours = posts.join(fine.select("id"), "id", "left_semi").withColumn("released", F.lit(True))
    relabel = relabelled(ours.join(keyed, "id", "left_semi"), keyword_names(post_tags, new_tags).unionByName(keywords)).select(posts.columns)
    new_posts = posts.join(fine.select("id"), "id", "left_anti").unionByName(ours.join(keyed, "id", "left_anti")).unionByName(relabel)
    return {"status": asked, "posts": new_posts.select(posts.columns), "tags": new_tags, "post_tags": new_links, "new_links": links, "comments": new_comments}
