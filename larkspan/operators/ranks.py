"""Places of rows kept ready: ids in ranges of about equal size, and the number of ids in each range.

A place is the number of ids in the ranges above, from the directory, and of those above in one range; a page lies in one range or two. A change
rewrites the ranges that its ids fall into, all in one job, and cuts those that have grown too large in another. The directory has
a row for `most` ids, so a million for a trillion; it's read on the driver, and tasks find an id's range in it by binary search.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators.feed import PAGE
from larkspan.sources.snapshots import Snapshots

#: Ids in a range, and the share of them up to which ranges are filled at first.
MOST, FILLED = 1_000_000, 0.7


def range_of(lows: list[int]) -> Callable[[Column], Column]:
    """The number of the range that an id falls into, of ranges that begin at `lows`; what is below the first one belongs to it.

    Spark has no search in a sorted array, and a look at each of a million ranges for each id would be as slow as the sort that the directory saves.
    """
    bounds = np.array(lows[1:], np.int64)

    @F.pandas_udf("int")
    def number(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), "right").astype(np.int32))

    return number


class RankDirectory:
    """The directory is a snapshot table with a part for each range, named by its smallest id and by its number of ids. An id between two ranges belongs to the lower one."""

    def __init__(self, spark: SparkSession, root: str, most: int = MOST) -> None:
        self.spark, self.tables, self.most = spark, Snapshots(spark, root), most

    def parts(self) -> dict[str, tuple[int, int]]:
        """By folder a range's smallest id and its number of ids."""
        found = self.tables.current().get("ranges", {})
        return {folder: tuple(json.loads(name)) for name, folder in found.items()}

    def _ordered(self) -> list[tuple[int, int, str]]:
        return sorted((low, n, folder) for folder, (low, n) in self.parts().items())

    def total(self) -> int:
        return sum(n for _, n in self.parts().values())

    def _staged(self, rows: DataFrame, dealt: bool = False) -> dict[str, tuple[int, int]]:
        """Rows (id, _part) in new folders, one for each part: the smallest id and the number of ids of each folder."""
        folder = self.tables.stage("ranges", rows, dealt)
        if not self.tables.parts(folder):
            return {}
        made = self.tables.load([folder], "id bigint, _part bigint").groupBy("_part").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).collect()  # a row for each range
        return {f"{folder}/_part={r['_part']}": (r["low"], r["n"]) for r in made}

    def _cut(self, ids: DataFrame, n: int, part: Column | None = None) -> dict[str, tuple[int, int]]:
        """n ids in ranges filled to their share, none over two parts: Spark cuts what it sorts into ranges by a sample."""
        if not n:
            return {}
        cut = ids.repartitionByRange(ceil(n / (self.most * FILLED)), "id")
        here = F.spark_partition_id().cast("bigint")
        return self._staged(cut.select("id", (here if part is None else F.shiftleft(here, 32) + part).alias("_part")), dealt=True)

    def _named(self, ranges: dict[str, tuple[int, int]]) -> dict[str, str]:
        return {json.dumps(at): folder for folder, at in ranges.items()}

    def build(self, rows: DataFrame) -> None:
        """From the ids (id) of a whole table; each id once."""
        ids = rows.select(F.col("id").cast("bigint").alias("id"))
        self.tables.swap({"ranges": self._named(self._cut(ids, ids.count()))}, replace=True)

    def change(self, new: DataFrame, gone: DataFrame) -> None:
        """Takes ids in and out. Only the ranges that these fall into are read and written."""
        new, gone = (rows.select(F.col("id").cast("bigint").alias("id")) for rows in (new, gone))
        ordered = self._ordered()
        if not ordered:
            self.build(new.join(gone, "id", "left_anti").distinct())
            return
        number = range_of([low for low, _, _ in ordered])
        hit = [r[0] for r in new.unionByName(gone).select(number("id").alias("k")).distinct().collect()]  # numbers of ranges
        if not hit:
            return
        ids = self.tables.load([ordered[k][2] for k in hit], "id bigint").unionByName(new).join(gone, "id", "left_anti").distinct()
        ranges = self._staged(ids.select("id", number("id").alias("_part")))
        large = {folder: n for folder, (_, n) in ranges.items() if n > self.most}
        if large:
            whole = {folder.split("/")[1] for folder in large}
            rows = self.tables.load([f"data/{name}" for name in whole], "id bigint, _part bigint").where(F.col("_part").isin([int(f.rpartition("=")[2]) for f in large]))
            ranges = {f: at for f, at in ranges.items() if f not in large} | self._cut(rows, sum(large.values()), F.col("_part"))
        before: dict[str, str | None] = dict.fromkeys(json.dumps(ordered[k][:2]) for k in hit)
        self.tables.swap({"ranges": before | self._named(ranges)})

    def position(self, post: int) -> DataFrame:
        """One row: how many ids are above one, from the directory and one range."""
        ordered = self._ordered()
        k = max(0, bisect_right([low for low, _, _ in ordered], post) - 1)
        above = sum(n for _, n, _ in ordered[k + 1 :])
        rows = self.tables.load([folder for _, _, folder in ordered[k : k + 1]], "id bigint")
        return rows.where(F.col("id") > post).agg((F.count(F.lit(1)) + above).alias("position"))

    def page(self, number: int, limit: int = PAGE) -> DataFrame:
        """A page of ids, the largest first: from the ranges that it lies in."""
        skip, wanted, folders, start = (number - 1) * limit, limit, [], 0
        for _, n, folder in reversed(self._ordered()):
            if skip >= n and not folders:
                skip -= n
                continue
            folders.append(folder)
            start += n
            if start >= skip + wanted:
                break
        rows = self.tables.load(folders, "id bigint")
        return rows.orderBy(F.desc("id")).offset(skip).limit(limit) if folders else rows
