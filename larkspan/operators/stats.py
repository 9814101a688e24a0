"""Counts and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def admin_counts(posts: DataFrame, comments: DataFrame, tags: DataFrame, users: DataFrame) -> DataFrame:
    """One row of counts, one pass for each table (posts count whether released or not)."""
    p = posts.agg(F.count_if(~F.col("deleted") & ~F.col("dirty")).cast("int").alias("posts"), F.count_if(~F.col("deleted") & F.col("dirty")).cast("int").alias("dirty_posts"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).cast("int").alias(name))
    return p.crossJoin(count(comments, "comments")).crossJoin(count(tags, "tags")).crossJoin(count(users, "users"))  # rows of one


def admin_stats(counts: DataFrame, disk: DataFrame) -> DataFrame:
    """One row: the counts, the bytes of all directories and the list of them (disk: label, bytes, files; a row for each directory)."""
    entry = F.struct("label", "bytes", "files")
    usage = disk.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("total_bytes"), F.array_sort(F.collect_list(entry)).alias("breakdown"))
    return counts.select("posts", "comments", "tags", "users", F.col("dirty_posts").alias("pending_import")).crossJoin(usage)  # rows of one


def user_profile(posts: DataFrame, user: int) -> DataFrame:
    """Number of posts, sum of scores and first post of a user; no row without posts."""
    mine = posts.where(F.col("user_id") == user)
    return mine.agg(F.count(F.lit(1)).alias("n_posts"), F.sum(F.coalesce("score", F.lit(0))).cast("long").alias("score"), F.min("created_at").alias("since")).where("n_posts > 0")


def user_profiles(posts: DataFrame) -> DataFrame:
    return posts.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_posts"), F.sum(F.coalesce("score", F.lit(0))).cast("long").alias("score"), F.min("created_at").alias("since"))


def batch_counters(results: DataFrame) -> DataFrame:
    """updated, failed and skipped of a back-fill (status)."""
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "updated").alias("updated"), F.count_if(F.col("status") == "failed").alias("failed")).withColumn("skipped", F.col("total") - F.col("updated") - F.col("failed"))
