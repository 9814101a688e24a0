"""Server-sent events as files: a sink whose frames count only once all of a write's tasks are through, and reading them back."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

HEARTBEAT = ": heartbeat\n\n"


@dataclass
class Written(WriterCommitMessage):
    """A task's file and the frames in it."""

    file: str
    frames: int


class FrameFiles:
    """Frames (column value) in a file for each task, named by a manifest once the write is complete.

    A task writes under a name of its own; what a failed one has written is in no manifest, so no reader sees it. Readers go by
    manifests: one for each write, or for each batch of a stream, where a second run of the batch replaces the first.
    """

    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.run = uuid.uuid4().hex

    def _system(self):
        from pyarrow.fs import FileSystem, LocalFileSystem

        return FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = self._system()
        system.create_dir(root)
        name, frames = f"frames-{self.run}-{uuid.uuid4().hex}.sse", 0
        with system.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                for value in batch.column("value"):
                    if value.is_valid:
                        out.write(value.as_buffer())
                        frames += 1
        return Written(name, frames)

    def _publish(self, name: str, messages: list[Written | None]) -> None:
        system, root = self._system()
        system.create_dir(root)
        staged = f"{root}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(staged) as out:
            out.write(json.dumps({"files": sorted(m.file for m in messages if m and m.frames), "frames": sum(m.frames for m in messages if m)}).encode())
        system.move(staged, f"{root}/_manifest-{name}.json")

    def _discard(self, messages: list[Written | None]) -> None:
        system, root = self._system()
        for m in messages:
            if m is not None:
                system.delete_file(f"{root}/{m.file}")


class FrameWriter(FrameFiles, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._publish(self.run, messages)

    def abort(self, messages: list[Written | None]) -> None:
        self._discard(messages)


class FrameStreamWriter(FrameFiles, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803  the interface's names
        self._publish(f"batch-{batchId:012d}", messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._discard(messages)


class FrameSink(DataSource):
    """rows.write.format("event_frames").mode("append").save(path), and the same of a stream; rows: value, a frame each (feeds.sse_frames)."""

    @classmethod
    def name(cls) -> str:
        return "event_frames"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("frames can only be appended")
        return FrameWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
        return FrameStreamWriter(self.options)


def committed(spark: SparkSession, path: str) -> list[str]:
    """The files of all complete writes."""
    path = path.rstrip("/")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    names = [s.getPath().getName() for s in system.listStatus(where)]
    files: list[str] = []
    for name in sorted(n for n in names if n.startswith("_manifest-")):
        stream = system.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
        try:
            files += json.loads(bytes(stream.readAllBytes()).decode())["files"]
        finally:
            stream.close()
    return [f"{path}/{f}" for f in files]


def events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of all complete writes below path: files are cut at the empty lines between frames, so tasks read parts of them."""
    files = committed(spark, path)
    if not files:
        return spark.createDataFrame([], schema)
    frames = spark.read.option("lineSep", "\n\n").text(files).where(F.col("value").startswith("data:"))
    return frames.select(F.from_json(F.trim(F.substring("value", 6, 1 << 30)), schema).alias("e")).where("e IS NOT NULL").select("e.*")
