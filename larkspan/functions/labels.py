"""Roles, labels and what a reader may see."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels of roles, labels in order of priority, and the labels that a level may see.
ROLES = {"admin": 10, "secret": 5, "member": 1, "guest": 0}
LABELS = ["sfw", "nsfp", "nsfw", "secret"]


def labels_of_level(level: int) -> list[str]:
    return LABELS if level >= ROLES["secret"] else LABELS[:3] if level >= ROLES["member"] else LABELS[:1]


def allowed_filters(requested: str, level: int) -> list[str]:
    """The requested labels (a comma list) that the level may see, in the order asked for; all of them if none is named."""
    allowed = labels_of_level(level)
    if not requested:
        return list(allowed)
    return list(dict.fromkeys(x for x in (part.strip() for part in requested.split(",")) if x in allowed))


def allowed_filters_column(requested: Column, level: Column) -> Column:
    """The same for columns."""
    some = lambda n: F.array(*[F.lit(x) for x in LABELS[:n]])
    allowed = F.when(level >= ROLES["secret"], some(4)).when(level >= ROLES["member"], some(3)).otherwise(some(1))
    asked = F.transform(F.split(requested, ","), lambda x: F.trim(x))
    return F.when(F.coalesce(requested, F.lit("")) == "", allowed).otherwise(F.array_intersect(asked, allowed))


def visible(labels: list[str], label: str = "label") -> Column:
    """Not deleted, finished, released, and of a label that is asked for. No labels: nothing."""
    return ~F.col("deleted") & ~F.col("dirty") & F.col("released") & F.col(label).isin(labels)


def priority(name: Column) -> Column:
    """A keyword's rank among labels; 0 for tags that are none."""
    return F.when(name == "secret", 3).when(name == "nsfw", 2).when(name == "nsfp", 1).otherwise(0)


def of_priority(rank: Column) -> Column:
    return F.when(rank == 3, "secret").when(rank == 2, "nsfw").when(rank == 1, "nsfp").otherwise("sfw")


def of_level(level: Column) -> Column:
    return F.when(level >= 5, "secret").when(level >= 1, "nsfw").otherwise("sfw")


def role_name(level: Column) -> Column:
    return F.when(level >= 10, "admin").when(level >= 5, "secret").when(level >= 1, "member").otherwise("guest")


def filter_options(level: Column) -> Column:
    """The labels that a role may choose from."""
    some = lambda n: F.array(*[F.lit(x) for x in LABELS[:n]])
    return F.when(level >= 5, some(4)).when(level >= 1, some(3)).otherwise(some(1))
