"""What the streams share: running one to the end of what is there, and reading what it wrote."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def configured(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Settings of the session for streams started inside."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, value in settings.items():
        spark.conf.set(k, value)
    try:
        yield
    finally:
        for k, value in before.items():
            if value is not None:
                spark.conf.set(k, value)
            else:
                spark.conf.unset(k)


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each micro-batch in a folder of its own, which a second run of the batch writes anew."""

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return append


def run_to_end(updates: DataFrame, out: str, checkpoint: str, by_clock: bool = False) -> list[dict]:
    """Runs a stream of updates over all that its source has, each micro-batch into its folder below `out`; the progress of its batches.

    The state store is the one that state with timers and a time to live needs. A later call with the same checkpoint goes on with what has come since.
    by_clock: state goes by processing time, for which a batch without data would always be due; there are none then.
    """
    with configured(updates.sparkSession, **{PROVIDER: ROCKSDB, IDLE: str(not by_clock).lower()}):
        stream = updates.writeStream.foreachBatch(append_to(out)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        stream.awaitTermination()
    return stream.recentProgress


def written(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The updates below `out`, with the number of their batch."""
    return spark.read.schema(f"{schema}, batch bigint").parquet(out)


def last_of(updates: DataFrame, *keys: str, within: str | None = None) -> DataFrame:
    """The last update of each key; `within` orders those of one batch."""
    order = F.struct("batch", within) if within else F.col("batch")
    others = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_last")).select(*keys, "_last.*")
