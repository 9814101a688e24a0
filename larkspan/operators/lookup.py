"""Scans of what isn't deleted (deleted_at is null), in order, and single rows by their keys. Filters and columns reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USER, ADMIN_USER = ["id", "created_at", "name", "email"], ["id", "name", "email", "level", "created_at"]


def live(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that aren't deleted, by id."""
    out = rows.where(F.col("deleted_at").isNull()).orderBy("id")
    return out.select(columns) if columns else out


def users(rows: DataFrame) -> DataFrame:
    return live(rows, USER)


def admin_users(rows: DataFrame) -> DataFrame:
    return live(rows, ADMIN_USER)


def by_key(rows: DataFrame, key: str, value: object, columns: list[str] | None = None) -> DataFrame:
    """The row with this key, if it's there; deleted ones don't count where rows can be deleted."""
    found = rows.where(F.col(key) == value)
    if "deleted_at" in rows.columns:
        found = found.where(F.col("deleted_at").isNull())
    return found.select(columns) if columns else found


def user_by_name(rows: DataFrame, name: str) -> DataFrame:
    """All columns, the password's hash too."""
    return by_key(rows, "name", name)


def invitations_of(invitations: DataFrame, user: int) -> DataFrame:
    """Invitations that a user made, newest first."""
    return invitations.where(F.col("created_by") == user).orderBy(F.desc("created_at"))


def without_size(posts: DataFrame) -> DataFrame:
    """Finished posts whose width or height isn't known."""
    return posts.where(((F.col("width") == 0) | (F.col("height") == 0)) & ~F.col("deleted") & ~F.col("dirty")).orderBy("id")


def images(posts: DataFrame) -> DataFrame:
    """Finished posts that are pictures."""
    return posts.where((F.col("content_type") == "image") & ~F.col("deleted") & ~F.col("dirty")).orderBy("id")
