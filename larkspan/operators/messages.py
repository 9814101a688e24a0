"""Conversations, threads and notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = 20


def inbox(messages: DataFrame, me: int) -> DataFrame:
    """One row for each partner of private messages: the latest message and how many are unread, latest first."""
    mine = messages.where((F.col("kind") == "private") & ((F.col("from_id") == me) | (F.col("to_id") == me)))
    mine = mine.withColumn("partner", F.when(F.col("from_id") == me, F.col("to_id")).otherwise(F.col("from_id"))).where(F.col("partner").isNotNull())
    last = F.struct("created_at", "id")
    unread = F.count_if((F.col("to_id") == me) & ~F.col("is_read"))
    return mine.groupBy("partner").agg(F.max("created_at").alias("last_at"), F.max_by("id", last).alias("last_id"), F.max_by("body", last).alias("last_body"), unread.alias("unread")).orderBy(F.desc("last_at"), "partner")


def inboxes(messages: DataFrame) -> DataFrame:
    """The same for every user at once."""
    private = messages.where("kind = 'private'")
    sides = private.select(F.col("from_id").alias("me"), F.col("to_id").alias("partner"), "created_at", "id", F.lit(False).alias("new")).unionByName(private.select(F.col("to_id").alias("me"), F.col("from_id").alias("partner"), "created_at", "id", (~F.col("is_read")).alias("new")))
    return sides.where("me IS NOT NULL AND partner IS NOT NULL").groupBy("me", "partner").agg(F.max("created_at").alias("last_at"), F.max_by("id", F.struct("created_at", "id")).alias("last_id"), F.count_if("new").alias("unread"))


def private(messages: DataFrame, me: int) -> DataFrame:
    return messages.where((F.col("kind") == "private") & ((F.col("from_id") == me) | (F.col("to_id") == me))).orderBy(F.desc("created_at"), F.desc("id"))


def sent(conversations: DataFrame, message: DataFrame) -> DataFrame:
    """Conversations (partner, last_at, last_body, unread) after a message (partner, created_at, body) of one's own: the partner's entry has it as its last, or is new."""
    new = message.select(F.col("partner").alias("_partner"), F.col("created_at").alias("_at"), F.col("body").alias("_body"))
    out = conversations.join(new, conversations["partner"] == new["_partner"], "full")
    return out.select(F.coalesce("partner", "_partner").alias("partner"), F.coalesce("_at", "last_at").alias("last_at"), F.coalesce("_body", "last_body").alias("last_body"), F.coalesce("unread", F.lit(0)).alias("unread"))


def opened(conversations: DataFrame, unread: Column, partner: int) -> DataFrame:
    """Conversations after one was opened: its unread count is 0, and the total of all (unread) is less by it, not below 0."""
    was = F.coalesce(F.max(F.when(F.col("partner") == partner, F.col("unread"))).over(Window.partitionBy(F.lit(1))), F.lit(0))  # a user's partners
    return conversations.withColumn("total_unread", F.greatest(F.lit(0), unread - was)).withColumn("unread", F.when(F.col("partner") == partner, 0).otherwise(F.col("unread")))


def thread(messages: DataFrame, a: int, b: int) -> DataFrame:
    between = (F.col("from_id") == a) & (F.col("to_id") == b) | (F.col("from_id") == b) & (F.col("to_id") == a)
    return messages.where((F.col("kind") == "private") & between).orderBy("created_at", "id")


def unread_count(messages: DataFrame, me: int) -> DataFrame:
    return messages.where((F.col("to_id") == me) & ~F.col("is_read")).agg(F.count(F.lit(1)).cast("int").alias("unread"))


def notifications(messages: DataFrame, posts: DataFrame, comments: DataFrame, me: int, number: int = 1, limit: int = PAGE) -> DataFrame:
    """A page of what isn't private, newest first, with the label of the post and the author of the comment it's about (deleted ones too)."""
    mine = messages.where((F.col("to_id") == me) & (F.col("kind") != "private")).orderBy(F.desc("created_at"), F.desc("id")).offset((number - 1) * limit).limit(limit)
    about = posts.select(F.col("id").alias("ref_post_id"), F.col("label").alias("post_label"))
    said = comments.select(F.col("id").alias("ref_comment_id"), F.col("user").alias("comment_user"))
    return mine.join(about, "ref_post_id", "left").join(said, "ref_comment_id", "left").select("id", "kind", "from_id", "created_at", "is_read", "ref_post_id", "ref_comment_id", "post_label", "comment_user").orderBy(F.desc("created_at"), F.desc("id"))


def unread_of(page: DataFrame) -> DataFrame:
    """How many of a loaded page are unread."""
    return page.agg(F.count_if(~F.col("is_read")).cast("int").alias("unread"))


def broadcast(users: DataFrame, body: str, created_at: str) -> DataFrame:
    """One system message to every user."""
    return users.select(F.lit("system").alias("kind"), F.col("id").alias("to_id"), F.lit(body).alias("body"), F.lit(created_at).cast("timestamp_ntz").alias("created_at"))


def marked_read(messages: DataFrame, me: int, partner: int | None = None, message: int | None = None) -> DataFrame:
    """messages after one, a thread's or all unread ones of a user were read."""
    hit = (F.col("to_id") == me) & ~F.col("is_read")
    if message is not None:
        hit &= F.col("id") == message
    if partner is not None:
        hit &= F.col("from_id") == partner
    return messages.withColumn("is_read", F.col("is_read") | F.coalesce(hit, F.lit(False)))
