"""Votes: the truth is the latest vote of each user on each entity; zero takes it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame) -> DataFrame:
    """entity, user_id, vote: the last by seq, without those taken back. Votes other than -1, 0 and 1 raise."""
    checked = log.withColumn("vote", F.when(F.col("vote").between(-1, 1), F.col("vote")).otherwise(F.raise_error(F.lit("a vote is -1, 0 or 1")).cast("int")))
    return checked.groupBy("entity", "user_id").agg(F.max_by("vote", "seq").cast("short").alias("vote")).where("vote <> 0")


def scores(log: DataFrame) -> DataFrame:
    """The score of each entity that ever had a vote."""
    last = log.groupBy("entity", "user_id").agg(F.max_by("vote", "seq").alias("vote"))
    return last.groupBy("entity").agg(F.sum("vote").cast("long").alias("score"))


def deltas(log: DataFrame) -> DataFrame:
    """What each vote changes: the new state less the one before it."""
    from pyspark.sql import Window

    before = F.lag("vote", 1, 0).over(Window.partitionBy("entity", "user_id").orderBy("seq"))
    return log.withColumn("delta", (F.col("vote") - before).cast("int"))


def preloaded(post_votes: DataFrame, comment_votes: DataFrame, tag_votes: DataFrame) -> DataFrame:
    """Scores of the three kinds of entities from their vote tables (entity, vote)."""
    kinds = [("post", post_votes), ("comment", comment_votes), ("post_tag", tag_votes)]
    union = None
    for kind, votes in kinds:
        part = votes.select(F.lit(kind).alias("entity_type"), "entity", "vote")
        union = part if union is None else union.unionByName(part)
    return union.groupBy("entity_type", "entity").agg(F.coalesce(F.sum("vote"), F.lit(0)).cast("long").alias("score"))


def upserted(votes: DataFrame, changes: DataFrame) -> DataFrame:
    """The vote table after a batch of changes (entity, user_id, vote, seq)."""
    old = votes.select("entity", "user_id", "vote", F.lit(-1).cast("long").alias("seq"))
    return latest(old.unionByName(changes.select("entity", "user_id", "vote", F.col("seq").cast("long").alias("seq"))))


def rescored(entities: DataFrame, new_scores: DataFrame) -> DataFrame:
    """entities (id, score) with the scores of new_scores (entity, score) where there are some."""
    found = new_scores.select(F.col("entity").alias("_e"), F.col("score").alias("_s"))
    return entities.join(found, entities["id"] == found["_e"], "left").withColumn("score", F.coalesce("_s", "score")).drop("_e", "_s")
