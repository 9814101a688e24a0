"""Streams of records with a time to live: status records (60 s), duplicates (900 s), and whatever else expires by itself.

`held` goes by the time of the records: a record ends where the newest one seen is `seconds` younger. `seen_lately`
goes by the clock, as a store with expiring keys does, through the state's own time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larkspan.streaming.runs import last_of


class Held(StatefulProcessor):
    """Keeps the latest record of a key until its timer; emits it when it comes (held) and when it goes (not held)."""

    def __init__(self, key: str, value: str, schema: str) -> None:
        self.key, self.value, self.schema = key, value, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"at bigint, {self.schema}")

    def _row(self, key: tuple, record: tuple, held: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "at": [record[0]], self.value: [record[1]], "held": [held]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        old = tuple(self.last.get()) if self.last.exists() else None
        new = old
        for frame in rows:  # one frame at a time, whatever a key's share of the batch
            top = frame.sort_values(["at", self.value]).iloc[-1]
            record = int(top["at"]), top[self.value].item() if hasattr(top[self.value], "item") else top[self.value]
            new = record if new is None else max(new, record)
        if new is not None and new != old:
            if old is not None:
                self.handle.deleteTimer(old[0] // 1000)
            self.last.update(new)
            self.handle.registerTimer(new[0] // 1000)
            yield self._row(key, new, True)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.last.exists():
            record = tuple(self.last.get())
            self.last.clear()
            yield self._row(key, record, False)

    def close(self) -> None:
        pass


def held(records: DataFrame, seconds: int, key: str, value: str) -> DataFrame:
    """Changes of what is held, of a stream of records (ts, key, value): key, at (microseconds), value, held.

    Of one key's records the latest counts, of equal times the one with the larger value. The watermark is `seconds` behind the newest record, so what arrives
    after it would be gone anyway, and nothing else is lost; state holds the records that live, no more.
    """
    types = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    rows = records.select(key, value, F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", f"{seconds} seconds")
    rows = rows.withColumn("at", F.unix_micros("ts"))
    out = f"{key} {types[key]}, at bigint, {value} {types[value]}, held boolean"
    return rows.groupBy(key).transformWithStateInPandas(Held(key, value, f"{value} {types[value]}"), out, "update", "eventTime")


def living(updates: DataFrame, key: str) -> DataFrame:
    """What is held after all updates (with their batch) that `held` gave."""
    return last_of(updates, key).where("held").drop("held")


class SeenLately(StatefulProcessor):
    """Tells of each key's rows whether the key had rows within the time to live; the state forgets by itself."""

    def __init__(self, key: str, milliseconds: int) -> None:
        self.key, self.milliseconds = key, milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "n bigint", ttlDurationMs=self.milliseconds)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.mark.get()[0] if self.mark.exists() else 0
        n = before + sum(len(r) for r in rows)
        self.mark.update((n,))
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "again": [before > 0]})

    def close(self) -> None:
        pass


def seen_lately(rows: DataFrame, seconds: float, key: str) -> DataFrame:
    """After each batch, for each of its keys: rows since the key was last forgotten (n), and whether there were any before (again)."""
    out = f"{key} {rows.schema[key].dataType.simpleString()}, n bigint, again boolean"
    return rows.select(key).groupBy(key).transformWithStateInPandas(SeenLately(key, int(seconds * 1000)), out, "update", "processingTime")
