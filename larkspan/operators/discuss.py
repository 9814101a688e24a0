"""Comments, their trees, and the tags of posts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.text import snippet
from larkspan.sources.scratch import settled


def tags_of_posts(post_tags: DataFrame, tags: DataFrame, votes: DataFrame, user: int) -> DataFrame:
    """Each post's tags with name, score and the user's own vote; votes: entity (post_tag id), user_id, vote."""
    own = votes.where(F.col("user_id") == user).select(F.col("entity").alias("_e"), F.col("vote").alias("_v"))
    named = post_tags.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id", "left")
    return named.join(own, named["id"] == own["_e"], "left").withColumn("vote", F.coalesce("_v", F.lit(0)).cast("short")).drop("_e", "_v")


def top_tags(post_tags: DataFrame, n: int = 5) -> DataFrame:
    """The n best tags of each post, and how many more it has."""
    place = Window.partitionBy("post_id").orderBy(F.desc("score"), "id", "tag_id")
    every = Window.partitionBy("post_id")
    out = post_tags.withColumn("place", F.row_number().over(place)).withColumn("hidden", F.greatest(F.count(F.lit(1)).over(every) - n, F.lit(0)))
    return out.where(F.col("place") <= n)


def comment_tree(comments: DataFrame) -> DataFrame:
    """comments (id, post_id, parent_id) with depth, root_id and path. Comments whose parent is gone are roots; siblings go by id.

    Every comment knows the path from its farthest known ancestor; in each round, written to the shared folder, that ancestor's own
    path goes in front, so known paths double and ten rounds do for a thousand levels. Neither rows nor depth
    have a limit. Comments in a circle, or below one, have no root and don't appear: their paths repeat a comment and are dropped.
    """
    nodes = comments.select("id", "post_id", "parent_id")
    alive = nodes.select(F.col("id").alias("_parent"))
    known = nodes.join(alive, nodes["parent_id"] == alive["_parent"], "left")
    root = F.col("_parent").isNull()
    state = known.select("id", "post_id", "parent_id", F.when(root, F.array("id")).otherwise(F.array("_parent", "id")).alias("path"), root.alias("whole"))
    state = settled(state, "comment-paths")
    done = [state.where("whole")]  # what is known stays where it was first written; rounds write the others alone
    open_ = state.where("NOT whole")
    known_ = state
    while not open_.isEmpty():
        up = known_.select(F.col("id").alias("_top"), F.col("path").alias("_above"), F.col("whole").alias("_whole"))
        longer = open_.join(up, F.element_at(open_["path"], 1) == up["_top"]).select("id", "post_id", "parent_id", F.concat("_above", F.slice("path", 2, F.size("path"))).alias("path"), F.col("_whole").alias("whole"))
        longer = settled(longer.where(F.col("whole") | (F.size(F.array_distinct("path")) == F.size("path"))), "comment-paths")
        done.append(longer.where("whole"))
        open_ = longer.where("NOT whole")
        known_ = reduce(DataFrame.unionByName, [*done, open_])
    return reduce(DataFrame.unionByName, done).select("id", "post_id", "parent_id", (F.size("path") - 1).alias("depth"), F.element_at("path", 1).alias("root_id"), "path")


def reply_notifications(comments: DataFrame) -> DataFrame:
    """A message for each reply to somebody else's comment (with an author): whom it goes to, from whom, its body, what it refers to."""
    parent = comments.select(F.col("id").alias("_id"), F.col("user").alias("to_user"))
    replies = comments.join(parent, comments["parent_id"] == parent["_id"]).where((F.col("to_user") != "") & (F.col("user") != F.col("to_user")))
    said = F.coalesce(snippet(F.col("content")), F.lit(""))
    body = F.concat(F.lit("@"), F.col("user"), F.lit(" replied to your comment"), F.when(said != "", F.concat(F.lit(": \u201c"), said, F.lit("\u201d"))).otherwise(""))
    return replies.select(F.lit("notification").alias("kind"), F.col("user").alias("from_user"), "to_user", body.alias("body"), F.col("post_id").alias("ref_post_id"), F.col("id").alias("ref_comment_id"))


def of_post(comments: DataFrame, post: int) -> DataFrame:
    """A post's comments by id; deleted ones (deleted_at) are left out."""
    return comments.where((F.col("post_id") == post) & F.col("deleted_at").isNull()).orderBy("id")
