"""A folder for a run's own files, shared by driver and executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[int, str] = {}


def _root(spark: SparkSession) -> str:
    """This session's folder under spark.checkpoint.dir; it's removed when the driver ends. A temporary folder only where that isn't set, on one machine."""
    context = spark.sparkContext
    if id(context) not in _ROOTS:
        root = context.getConf().get("spark.checkpoint.dir")
        if not root:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = f"file://{tempfile.mkdtemp(prefix='larkspan-')}"
        _ROOTS[id(context)] = f"{root.rstrip('/')}/larkspan-{uuid.uuid4().hex}"
        atexit.register(_removed, spark, _ROOTS[id(context)])
    return _ROOTS[id(context)]


def _removed(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may be gone already; the folder is scratch
        pass


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the session's folder."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def settled(rows: DataFrame, name: str) -> DataFrame:
    """rows, written to the shared folder and read again: later jobs neither repeat their work nor need their lineage."""
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
