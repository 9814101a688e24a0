"""Registered queries that run streams over whole tables to their end; their SQL is that of the same results in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.plans import records as batch
from larkspan.plans import values
from larkspan.plans import views as v
from larkspan.plans.registry import ORACLE_SQL, _folder, query
from larkspan.sources import changes, feeds
from larkspan.sources.scratch import folder, settled
from larkspan.sources.snapshots import Snapshots, part_of
from larkspan.streaming import jobs, records
from larkspan.streaming.runs import append_to, run_to_end, written
from larkspan.streaming.votes import SCORE_TABLE, VOTE_TABLE, flush, scores_now


def _events(spark: SparkSession, d: str) -> DataFrame:
    """events as a stream."""
    path = f"{d}/events.parquet"
    return spark.readStream.schema(v.table(spark, d, "events").schema).parquet(path if _folder(spark, path) else f"{d}/events*.parquet")


def _run(updates: DataFrame, schema: str) -> DataFrame:
    """All updates of a stream that runs to its end, with their batch."""
    spark = updates.sparkSession
    out = folder(spark, "updates")
    run_to_end(updates, out, folder(spark, "checkpoint"))
    return written(spark, out, schema)


@query("live_records_stream", ORACLE_SQL["duplicate_records"])
def live_records_stream(spark, d):
    """Records that live for two days, as a stream whose state forgets them."""
    rows = _events(spark, d).select((F.col("event_id") % 40).alias("post_id"), "ts", F.col("event_id").alias("last"))
    updates = _run(records.held(rows, 2 * 24 * 3600, "post_id", "last"), "post_id bigint, at bigint, last bigint, held boolean")
    return records.living(updates, "post_id").select("post_id", "last")


@query("job_states_stream", ORACLE_SQL["job_states"])
def job_states_stream(spark, d):
    """The life cycle of all jobs as a stream."""
    updates = _run(jobs.job_updates(values.job_log(_events(spark, d)), None, None, order=("seq",)), jobs.UPDATE)
    return jobs.job_board(updates).select("job", "status", "progress", "total")


@query("back_fill_stream", ORACLE_SQL["back_fill_progress"].replace("ELSE 'stalled' END AS reason", "WHEN max(ts) + INTERVAL 3 DAYS < (SELECT max(ts) FROM m) THEN 'stalled' ELSE 'running' END AS reason"))
def back_fill_stream(spark, d):
    """Back-fills as a stream of their messages: counted, done, stalled by a timer, or still running when the messages end."""
    told = settled(batch.back_fill_messages(spark, d), "messages")
    path = told.inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(told.schema).parquet(path).withColumn("total", F.when(F.col("job") == 3, 1000000).otherwise(90))
    found = jobs.job_board(_run(jobs.job_updates(stream, 3 * 24 * 60, None, order=("at", "kind", "n")), jobs.UPDATE))
    reason = F.when(F.col("status") == "done", "complete").otherwise(F.col("status"))
    return found.select("job", "total", "updated", (F.col("failed") + F.col("lost")).alias("failed"), "lost", "current", F.timestamp_micros("last_at").cast("timestamp_ntz").alias("last_at"), reason.alias("reason"))



@query("change_feed", """SELECT 'insert' AS change, 2::BIGINT AS version, -id - 1 AS id, user_id, label, score FROM posts WHERE id % 25 = 0
    UNION ALL SELECT 'delete', 2, id, user_id, label, score FROM posts WHERE id % 14 = 3
    UNION ALL SELECT 'update', 2, id, user_id, label, score + 1 FROM posts WHERE id % 10 = 0 AND id % 14 <> 3""", "posts")
def change_feed(spark, d):
    """What a reader of posts gets that knows the state before a change of all kinds."""
    tables, p = Snapshots(spark, folder(spark, "tables")), v.posts(spark, d).select("id", "user_id", "label", "score")
    new = p.where("id % 25 = 0").withColumn("id", -F.col("id") - 1)
    later = p.where("id % 14 <> 3").withColumn("score", F.when(F.col("id") % 10 == 0, F.col("score") + 1).otherwise(F.col("score"))).unionByName(new)
    for rows in (p, later):
        tables.swap({"posts": tables.stage_parts("posts", rows.withColumn("_part", part_of("id")), list(range(64)))})
    return changes.feed(tables, "posts", ["id"], 1, p.schema)


def _flushed(spark: SparkSession, d: str) -> Snapshots:
    """The vote and score tables after the whole vote log went through the sink."""
    tables = Snapshots(spark, folder(spark, "tables"))
    flush(v.votes_of(_events(spark, d)), tables, folder(spark, "checkpoint"), None).awaitTermination()
    return tables


@query("vote_sink_scores", ORACLE_SQL["vote_scores"])
def vote_sink_scores(spark, d):
    return _flushed(spark, d).read("scores", SCORE_TABLE).select("entity", "score")


@query("vote_sink_votes", ORACLE_SQL["user_vote_table"])
def vote_sink_votes(spark, d):
    return _flushed(spark, d).read("votes", VOTE_TABLE).select("entity", "user_id", "vote")


@query("vote_log_scores", ORACLE_SQL["vote_scores"])
def vote_log_scores(spark, d):
    """The same scores from a sink that writes each batch beside the tables."""
    tables = Snapshots(spark, folder(spark, "tables"))
    flush(v.votes_of(_events(spark, d)), tables, folder(spark, "checkpoint"), None, logged=True).awaitTermination()
    return scores_now(tables)


@query("queue_items_stream", ORACLE_SQL["queue_items"])
def queue_items_stream(spark, d):
    """Queue records popped as a stream of text files, some at a time."""
    path, out = folder(spark, "queue"), folder(spark, "popped")
    values.queue_records(spark, d).write.text(path)
    items = feeds.queue_items(spark.readStream.option("maxFilesPerTrigger", 500).text(path))
    items.writeStream.foreachBatch(append_to(out)).option("checkpointLocation", folder(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return written(spark, out, "post_id int, filename string, thumbnail_filename string, job_key string").drop("batch")


@query("folder_usage", "SELECT lang AS label, CAST(sum(strlen(doc_id::VARCHAR) + 1) AS BIGINT) AS bytes FROM documents WHERE doc_id % 3 <> 0 GROUP BY lang")
def folder_usage(spark, d):
    """Bytes below the folder of each language, without one of its subfolders."""
    path = folder(spark, "files")
    docs = v.table(spark, d, "documents").select("lang", F.when(F.col("doc_id") % 3 == 0, "cache").otherwise("kept").alias("sub"), F.col("doc_id").cast("string").alias("value"))
    docs.write.partitionBy("lang", "sub").text(path)
    labels = [r[0] for r in docs.select("lang").distinct().collect()]  # the languages, a few
    return feeds.directory_usage(spark, {x: f"{path}/lang={x}" for x in labels}, ["sub=cache"]).select("label", "bytes")
