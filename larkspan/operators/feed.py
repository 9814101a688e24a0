"""Feed pages: offset and keyset paging, positions, windows around a post."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from larkspan.functions.labels import visible
from larkspan.sources.scratch import settled

PAGE = 50


def page(posts: DataFrame, labels: list[str], number: int = 1, limit: int = PAGE) -> DataFrame:
    return posts.where(visible(labels)).orderBy(F.desc("id")).offset((number - 1) * limit).limit(limit)


def with_vote(rows: DataFrame, votes: DataFrame, user: int, key: str = "id") -> DataFrame:
    """rows and the user's own vote on each (0 without one); votes: entity, user_id, vote."""
    own = votes.where(F.col("user_id") == user).select(F.col("entity").alias("_entity"), F.col("vote").alias("_vote"))
    return rows.join(own, rows[key] == own["_entity"], "left").withColumn("vote", F.coalesce("_vote", F.lit(0)).cast("short")).drop("_entity", "_vote")


def by_user(posts: DataFrame, user: int, labels: list[str]) -> DataFrame:
    return posts.where(visible(labels) & (F.col("user_id") == user)).orderBy(F.desc("id"))


def older(posts: DataFrame, labels: list[str], than: int, limit: int = PAGE) -> DataFrame:
    return posts.where(visible(labels) & (F.col("id") < than)).orderBy(F.desc("id")).limit(limit)


def newer(posts: DataFrame, labels: list[str], than: int, limit: int = PAGE, mode: str = "compat") -> DataFrame:
    """The next newer posts, newest first.

    contiguous: those nearest the cursor. compat: one more is fetched, and if it's there the nearest is dropped, as existing clients see it.
    """
    found = posts.where(visible(labels) & (F.col("id") > than)).orderBy("id")
    if mode == "contiguous":
        return found.limit(limit).orderBy(F.desc("id"))
    return found.limit(limit + 1).orderBy(F.desc("id")).limit(limit)


def has_more(posts: DataFrame, labels: list[str], than: int, limit: int = PAGE, side: str = "older") -> DataFrame:
    """One row: whether more than a page lies beyond the cursor (from one row more than a page)."""
    beyond = F.col("id") < than if side == "older" else F.col("id") > than
    return posts.where(visible(labels) & beyond).limit(limit + 1).agg((F.count(F.lit(1)) > limit).alias("has_more"))


def full_page(rows: DataFrame, limit: int = PAGE) -> DataFrame:
    """The client's guess: there's more if the page is full."""
    return rows.agg((F.count(F.lit(1)) == limit).alias("has_more"))


def around(posts: DataFrame, labels: list[str], post: int, limit: int, mode: str = "compat") -> DataFrame:
    """`limit` newer posts, the post itself and `limit` older ones, newest first; and on each row whether there are more on either side (has_newer, has_older)."""
    me = posts.where(visible(labels) & (F.col("id") == post))
    # One row more than asked for tells that there are more. Of the newer ones `compat` then drops the nearest, `contiguous` the farthest.
    near = posts.where(visible(labels) & (F.col("id") > post)).orderBy("id").limit(limit + 1).withColumn("_side", F.lit(1))
    far = older(posts, labels, post, limit + 1).withColumn("_side", F.lit(-1))
    both = near.unionByName(far).unionByName(me.withColumn("_side", F.lit(0)))
    side = Window.partitionBy("_side")  # a page and a few rows
    found = both.withColumn("_n", F.count(F.lit(1)).over(side)).withColumn("_place", F.row_number().over(side.orderBy(F.col("id") * F.col("_side"))))
    every = Window.partitionBy(F.lit(1))
    first = F.when((F.col("_side") == 1) & (F.col("_n") > limit), 2).otherwise(1) if mode == "compat" else F.lit(1)
    found = found.withColumns({"has_newer": F.coalesce(F.max(F.when(F.col("_side") == 1, F.col("_n") > limit)).over(every), F.lit(False)), "has_older": F.coalesce(F.max(F.when(F.col("_side") == -1, F.col("_n") > limit)).over(every), F.lit(False))})
    kept = found.where((F.col("_place") >= first) & (F.col("_place") < first + limit))
    return kept.drop("_side", "_n", "_place").orderBy(F.desc("id"))


def position(posts: DataFrame, labels: list[str], post: int, limit: int = PAGE) -> DataFrame:
    """A post's place in the feed from 0 (hidden posts have one too), and its page."""
    return posts.where(visible(labels) & (F.col("id") > post)).agg(F.count(F.lit(1)).alias("position")).withColumn("page", (F.floor(F.col("position") / limit) + 1).cast("long"))


def sorted_parts(rows: DataFrame, order: Column) -> tuple[DataFrame, list[Row]]:
    """rows sorted over all partitions, with _part and _place (from 0) in it, written once; and each partition's rows (n), smallest and largest `_key`, in order.

    Spark cuts the partitions by a sample of the keys, so they are about even for dense, sparse and hashed keys alike.
    """
    placed = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    placed = settled(placed.select("*", F.shiftright("_at", 33).cast("int").alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")).drop("_at"), "sorted")
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_key").alias("low"), F.max("_key").alias("high"))
    return placed, sorted(parts.collect(), key=lambda r: r["_part"])  # a row for each partition, not for keys


def ranked(rows: DataFrame, key: str = "id", descending: bool = True, name: str = "position") -> DataFrame:
    """rows and their place from 0 by a key; equal keys in any order. No window: rows are numbered where the sort has put them, after the rows of the partitions before."""
    keyed = rows.withColumn("_key", F.col(key))
    placed, parts = sorted_parts(keyed, F.desc("_key") if descending else F.asc("_key"))
    before = list(accumulate((p["n"] for p in parts), initial=0))
    offsets = rows.sparkSession.createDataFrame([(p["_part"], b) for p, b in zip(parts, before, strict=False)], "_part int, _before bigint")
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_place") + F.col("_before")).select(*rows.columns, name)


def summed_before(rows: DataFrame, key: str, weight: str, name: str) -> tuple[DataFrame, int]:
    """rows and the sum of a whole number over the rows before them by a key (equal keys in any order), written once; and the sum over all."""
    placed, _ = sorted_parts(rows.withColumn("_key", F.col(key)), F.asc("_key"))
    sums = sorted(placed.groupBy("_part").agg(F.sum(weight).alias("total")).collect(), key=lambda r: r["_part"])  # a row for each partition
    before = list(accumulate((p["total"] for p in sums), initial=0))
    offsets = rows.sparkSession.createDataFrame([(p["_part"], b) for p, b in zip(sums, before, strict=False)], "_part int, _before bigint")
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    found = placed.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(F.broadcast(offsets), "_part")
    return settled(found.withColumn(name, F.col("_inside") + F.col("_before")).select(*rows.columns, name), "summed"), before[-1]


def neighbours(posts: DataFrame, labels: list[str]) -> DataFrame:
    """id of each visible post, and of the next newer and the next older one.

    Inside the partitions of a sort the neighbours are the rows before and after; at a partition's edges they come
    from the partitions beside it.
    """
    placed, parts = sorted_parts(posts.where(visible(labels)).select("id", F.col("id").alias("_key")), F.asc("_key"))
    inside = Window.partitionBy("_part").orderBy("_place")
    edges = [(p["_part"], b["low"] if b else None, a["high"] if a else None) for p, a, b in zip(parts, [None, *parts], [*parts[1:], None], strict=False)]
    edges_ = posts.sparkSession.createDataFrame(edges, f"_part int, _above {placed.schema['id'].dataType.simpleString()}, _below {placed.schema['id'].dataType.simpleString()}")
    found = placed.select("id", "_part", F.lead("id").over(inside).alias("_newer"), F.lag("id").over(inside).alias("_older")).join(F.broadcast(edges_), "_part")
    return found.select("id", F.coalesce("_newer", "_above").alias("newer_id"), F.coalesce("_older", "_below").alias("older_id"))


def grid_rows(posts: DataFrame, labels: list[str], columns: int, expanded: int | None = None) -> DataFrame:
    """Rows of `columns` posts as a grid shows them, and a marker row after the one with the expanded post: row, kind, ids."""
    placed = ranked(posts.where(visible(labels)).select("id")).withColumn("row", F.floor(F.col("position") / columns).cast("long"))
    rows = placed.groupBy("row").agg(F.sort_array(F.collect_list("id"), asc=False).alias("ids")).select("row", F.lit("posts").alias("kind"), "ids")
    if expanded is None:
        return rows
    marker = placed.where(F.col("id") == expanded).select("row", F.lit("expanded").alias("kind"), F.array("id").alias("ids"))
    return rows.unionByName(marker)


def next_cursor(rows: DataFrame, key: str = "id") -> DataFrame:
    """The smallest and largest id of what is loaded; 0 for nothing."""
    return rows.agg(F.coalesce(F.min(key), F.lit(0)).alias("oldest"), F.coalesce(F.max(key), F.lit(0)).alias("newest"))


#: Posts that a profile shows.
SHOWN = 33


def shown(posts: DataFrame, limit: int = SHOWN) -> DataFrame:
    """The first posts of a loaded list, as a profile shows them."""
    return posts.orderBy(F.desc("id")).limit(limit)


def without(rows: DataFrame, post: int) -> DataFrame:
    """A loaded list without one post."""
    return rows.where(F.col("id") != post)


def appended(loaded: DataFrame, page: DataFrame) -> DataFrame:
    """A loaded list (rows with their place) and the page after it. What is in both stays twice, as clients see it."""
    last = loaded.agg(F.coalesce(F.max("place"), F.lit(-1)).alias("_last"))  # one row
    order = Window.orderBy(F.desc("id"))  # of one page
    new = page.withColumn("_n", F.row_number().over(order)).crossJoin(last).withColumn("place", (F.col("_last") + F.col("_n")).cast(loaded.schema["place"].dataType))
    return loaded.unionByName(new.select(loaded.columns))
