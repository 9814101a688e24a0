"""Search by tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.functions.labels import visible


def parse_search(text: str) -> tuple[str | None, list[str]]:
    """A search box: at most one user:<name>, anywhere and in any case; the other words are tags."""
    user, tags = None, []
    for word in text.split():
        if word.lower().startswith("user:") and len(word) > 5:
            user = user or word[5:]
        else:
            tags.append(word)
    return user, tags


def parse_path(query: str) -> list[str]:
    """Tags of a search path, between the characters %20."""
    return query.split("%20")


def by_tags(posts: DataFrame, post_tags: DataFrame, tags: DataFrame, names: list[str], labels: list[str], user: int | None = None) -> DataFrame:
    """Visible posts with any of the tags, newest first. A semi-join, so a post with several tags appears once."""
    wanted = post_tags.join(tags.where(F.col("name").isin(names)).select(F.col("id").alias("tag_id")), "tag_id", "left_semi")
    seen = visible(labels) if user is None else visible(labels) & (F.col("user_id") == user)
    return posts.where(seen).join(wanted, posts["id"] == wanted["post_id"], "left_semi").orderBy(F.desc("id"))


def ids_with_tag(post_tags: DataFrame, tag: int) -> DataFrame:
    return post_tags.where(F.col("tag_id") == tag).select("post_id").distinct()


def suggestions(tags: DataFrame, token: str, existing: list[str], limit: int = 8) -> DataFrame:
    """Tags that contain the token in any case and aren't there already, the first by id."""
    there = [x.lower() for x in existing]
    return tags.where(F.contains(F.lower("name"), F.lit(token.lower())) & ~F.lower("name").isin(there)).orderBy("id").limit(limit)
