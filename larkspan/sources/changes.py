"""The changes between states of a snapshot table: which rows came, changed and went, from the parts that changed alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspan.sources.snapshots import Snapshots

CHANGES = ("insert", "update", "delete")


def changed_parts(before: dict[str, str], after: dict[str, str]) -> list[str]:
    """Parts whose folder isn't the same in both states."""
    return sorted(p for p in before.keys() | after.keys() if before.get(p) != after.get(p))


def between(tables: Snapshots, table: str, keys: list[str], old: int, new: int, schema: StructType | str) -> DataFrame:
    """change (insert, update, delete), version (new) and the table's columns: what a row is after the change, or was before it's deleted.

    Rows are told apart by their keys (null is a value), which must be those that the table's parts go by, if it has some. Rows rewritten without a change give nothing.
    """
    before, after = tables.at(old).get(table, {}), tables.at(new).get(table, {})
    parts = changed_parts(before, after)
    was, now = (tables.load([f[p] for p in parts if p in f], schema) for f in (before, after))
    others = [c for c in now.columns if c not in keys]
    side = lambda rows, name: rows.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], F.struct(*now.columns).alias(f"_{name}"))
    same_key = reduce(lambda a, b: a & b, [F.col(f"_was_{k}").eqNullSafe(F.col(f"_now_{k}")) for k in keys])
    both = side(was, "was").join(side(now, "now"), same_key, "full_outer")
    same = reduce(lambda a, b: a & b, [F.col(f"_was.{c}").eqNullSafe(F.col(f"_now.{c}")) for c in others], F.lit(True))
    change = F.when(F.col("_was").isNull(), "insert").when(F.col("_now").isNull(), "delete").when(~same, "update")
    return both.select(change.alias("change"), F.lit(new).cast("long").alias("version"), F.coalesce("_now", "_was").alias("_row")).where("change IS NOT NULL").select("change", "version", "_row.*")


def feed(tables: Snapshots, table: str, keys: list[str], since: int, schema: StructType | str) -> DataFrame:
    """All changes after version `since`, version by version; one row with change `heartbeat` and the newest version if there is none.

    The newest version is the cursor for the next call. A version that is no longer kept raises: then the table has to be read whole.
    """
    newest = tables.newest()
    versions = [since, *range(since + 1, newest + 1)] if since < newest else [newest]
    steps = [between(tables, table, keys, a, b, schema) for a, b in zip(versions, versions[1:], strict=False)]
    empty = tables.spark.createDataFrame([], schema).select(F.lit("").alias("change"), F.lit(0).cast("long").alias("version"), "*")
    changes = reduce(DataFrame.unionByName, steps) if steps else empty
    none = changes.limit(1).agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")  # one row or none
    beat = none.select(F.lit("heartbeat").alias("change"), F.lit(newest).cast("long").alias("version"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema.fields[2:]])
    return changes.unionByName(beat)
