"""Import: filters, deduplication, queue positions and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.text import importable
from larkspan.operators.feed import ranked

#: Rows that one run of load-new inserts at least, if there are so many.
ENOUGH = 500


def batch_dedup(candidates: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Candidates whose key the table doesn't have. Equal candidates of one batch all pass, as they do in one round trip."""
    return candidates.join(existing.select(key).distinct(), key, "left_anti").select(candidates.columns)


def sequential_dedup(candidates: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """The same row by row: of equal candidates the first by `order` passes."""
    fresh = batch_dedup(candidates, existing, key)
    first = fresh.groupBy(key).agg(F.min(F.struct(F.col(order), *[F.col(c) for c in fresh.columns if c not in (key, order)])).alias("_first"))
    return first.select(key, "_first.*").select(fresh.columns)


def outcome(name: Column, known: Column, ok: Column) -> Column:
    return F.when(~F.coalesce(importable(name), F.lit(False)), "filtered_ext").when(known, "skipped_dedup").when(~ok, "insert_errors").otherwise("inserted")


def counters(rows: DataFrame) -> DataFrame:
    """One row with the number of rows of each outcome."""
    kinds = ("filtered_ext", "skipped_dedup", "insert_errors", "inserted")
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("outcome") == k).alias(k) for k in kinds])


def until_enough(pages: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """Pages (page, inserted) in order until at least `enough` rows are in; a page of a feed is a row, so one window orders them."""
    before = Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("before", F.coalesce(F.sum("inserted").over(before), F.lit(0)).cast("long")).where(F.col("before") < enough)


def min_cursor(items: DataFrame, column: str) -> DataFrame:
    return items.agg(F.coalesce(F.min(column), F.lit(0)).cast("long").alias("cursor"))


def queue_positions(posts: DataFrame) -> DataFrame:
    """Place from 1 of each unfinished post by id."""
    return ranked(posts.where("dirty AND NOT deleted").select("id"), descending=False).select("id", (F.col("position") + 1).alias("position"))


def queue_position(posts: DataFrame, post: int) -> DataFrame:
    return posts.where(F.col("dirty") & ~F.col("deleted") & (F.col("id") <= post)).agg(F.count(F.lit(1)).alias("position"))


def eta(position: Column, rate: Column, whole: Column) -> Column:
    """Seconds until a place in the queue is reached; -1 if no rate is known; `whole`, the whole queue's, for what has no place."""
    return F.when(rate <= 0, -1).when(position <= 0, whole).otherwise(F.ceil(position / rate)).cast("int")


def known(candidates: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """candidates with `known`: whether the table has their key."""
    there = existing.select(key).distinct().withColumn("known", F.lit(True))
    return candidates.join(there, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def first_unfinished(posts: DataFrame, user: int) -> DataFrame:
    return posts.where((F.col("user_id") == user) & (F.col("dirty") | ~F.col("released")) & ~F.col("deleted")).orderBy("id").limit(1)


def is_dirty(posts: DataFrame, post: int) -> DataFrame:
    return posts.where(F.col("id") == post).agg(F.coalesce(F.max("dirty"), F.lit(False)).alias("dirty"))


def source_of(uploaded: Column, url: Column) -> Column:
    """Where a post's file comes from."""
    return F.when(F.coalesce(uploaded, F.lit("")) != "", "file").when(F.coalesce(url, F.lit("")) != "", "url").otherwise("invalid")


def phases(log: DataFrame) -> DataFrame:
    """The phase of each post from its events (id, seq, kind): queued, claimed, processed, done, failed or invalid, by the last that counts.

    A failed or invalid post is gone and its status counts one failure more; nothing that comes after ending counts.
    """
    ends = F.min(F.when(F.col("kind").isin("done", "failed", "invalid"), F.col("seq"))).over(Window.partitionBy("id"))
    live = log.withColumn("_ends", ends).where("_ends IS NULL OR seq <= _ends")
    out = live.groupBy("id").agg(F.max_by("kind", "seq").alias("phase"))
    return out.select("id", "phase", F.col("phase").isin("failed", "invalid").alias("deleted"), (F.col("phase").isin("failed", "invalid")).cast("int").alias("failures"))


def processed(post: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Next state of unfinished posts: deleted if the source is invalid or the picture is there already, else finalized."""
    doubles = duplicates.select(F.col("id").alias("_d")).distinct()
    joined = post.join(doubles, post["id"] == doubles["_d"], "left")
    state = F.when(~F.col("dirty"), F.when(F.col("released"), "released").otherwise("finalized")).when(F.col("source") == "invalid", "deleted_invalid").when(F.col("_d").isNotNull(), "deleted_duplicate").otherwise("finalized")
    return joined.withColumn("state", state).drop("_d")


def queue_counters(log: DataFrame) -> DataFrame:
    """Counters of a status log (id, seq, status in pending, active, imported, failed), by each item's latest status."""
    last = log.groupBy("id").agg(F.max_by("status", "seq").alias("status"))
    named = [F.count_if(F.col("status") == s).alias(s) for s in ("pending", "active", "imported", "failed")]
    return last.agg(F.count(F.lit(1)).alias("total"), *named, F.count_if(F.col("status").isin("imported", "failed")).alias("processed"))
