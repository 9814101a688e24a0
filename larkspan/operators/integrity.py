"""Rules that Spark doesn't enforce, as queries for what breaks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.functions.labels import LABELS


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that appear more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose non-null key has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def unknown_labels(posts: DataFrame, column: str = "label") -> DataFrame:
    return posts.where(F.col(column).isNull() | ~F.col(column).isin(LABELS))
