"""Tables as folders under one manifest: a change writes new folders, then one new manifest makes all of them current at once.

A manifest names, for each table, the folder of each of its parts (hash buckets; a table without parts has one). A
change rewrites the parts that it touches; the others stay where they are. Manifests are numbered and
never changed: the highest one that's there is current, so a crash at any step leaves the tables as they were
before or as they are after, of all tables together. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts of a table that is written in parts: what one change reads and writes again at least is a part.
PARTS = 64
#: Manifests that are kept, with the folders that they name, for readers that began before a change.
KEPT = 3
WHOLE = "all"


def part_of(*keys: str) -> F.Column:
    return F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")


class Snapshots:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._system.listStatus(path)) if self._system.exists(path) else []

    def _numbers(self) -> list[int]:
        return [int(n[2:-5]) for n in self.names("manifests") if n.startswith("m-") and n.endswith(".json")]

    def _load(self, number: int) -> dict[str, dict[str, str]]:
        stream = self._system.open(self._path(f"{self.root}/manifests/m-{number:019d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self) -> dict[str, dict[str, str]]:
        """By table the folder of each part; empty before the first change."""
        numbers = self._numbers()
        return self._load(max(numbers)) if numbers else {}

    def newest(self) -> int:
        """The number of the current state; 0 before the first change."""
        return max(self._numbers(), default=0)

    def at(self, number: int) -> dict[str, dict[str, str]]:
        """By table the folder of each part, as they were in a state that is still kept; of state 0 none."""
        if number and number not in self._numbers():
            raise LookupError(f"state {number} is not kept")
        return self._load(number) if number else {}

    def load(self, folders: list[str], schema: StructType | str) -> DataFrame:
        """The rows of some folders."""
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in sorted(folders)])

    def read(self, table: str, schema: StructType | str | None = None, parts: list[int] | None = None) -> DataFrame:
        """A table as it is now, or some parts of it."""
        found = self.current().get(table, {})
        folders = [f for p, f in found.items() if parts is None or p in {str(x) for x in parts}]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in sorted(folders)])

    def write(self, table: str, rows: DataFrame) -> None:
        """A whole table anew."""
        self.swap({table: {WHOLE: self.stage(table, rows)}}, replace=True)

    def stage(self, table: str, rows: DataFrame, dealt: bool = False) -> str:
        """Writes rows to a new folder, which no manifest names yet; a column _part makes folders of parts in it. dealt: no part is in two tasks already."""
        folder = f"data/{table}-{uuid.uuid4().hex}"
        writer = (rows if dealt else rows.repartition("_part")).write.partitionBy("_part") if "_part" in rows.columns else rows.write
        writer.parquet(f"{self.root}/{folder}")
        return folder

    def stage_parts(self, table: str, rows: DataFrame, parts: list[int]) -> dict[str, str | None]:
        """The same for rows with _part, of the given parts: each one's folder, None for those without a row."""
        folder = self.stage(table, rows)
        made = self.parts(folder)
        return {str(p): made.get(str(p)) for p in parts}

    def parts(self, folder: str) -> dict[str, str]:
        """The folder of each part in a staged one."""
        return {n.removeprefix("_part="): f"{folder}/{n}" for n in self.names(folder) if n.startswith("_part=")}

    def swap(self, changes: dict[str, dict[str, str | None]], replace: bool = False) -> None:
        """Makes staged folders current, of all tables in one step: a manifest with the next number is renamed into place."""
        now, number = self.current(), max(self._numbers(), default=0) + 1
        for table, parts in changes.items():
            merged = parts if replace else now.get(table, {}) | parts
            now[table] = {p: f for p, f in merged.items() if f is not None}
        fresh = self._path(f"{self.root}/manifests/new-{uuid.uuid4().hex}")
        out = self._system.create(fresh, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        if not self._system.rename(fresh, self._path(f"{self.root}/manifests/m-{number:019d}.json")):
            raise OSError("another writer was faster")
        self._clean()

    def _clean(self) -> None:
        """Removes old manifests, and folders that none of the kept ones names."""
        numbers = sorted(self._numbers())
        for n in numbers[:-KEPT]:
            self._system.delete(self._path(f"{self.root}/manifests/m-{n:019d}.json"), False)
        used = {f.split("/")[1] for n in numbers[-KEPT:] for parts in self._load(n).values() for f in parts.values()}
        for name in self.names("data"):
            if name not in used:
                self._system.delete(self._path(f"{self.root}/data/{name}"), True)
