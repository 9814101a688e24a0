import json

import pytest
from pyspark.sql import functions as F

from larkspan.sources import changes, feeds, frames
from larkspan.sources.snapshots import Snapshots, part_of
from tests.test_sources import address  # noqa: F401  a fixture

SCHEMA = "id bigint, score bigint, label string"


def write(tables, rows, parts):
    frame = tables.spark.createDataFrame(rows, SCHEMA).withColumn("_part", part_of("id"))
    tables.swap({"posts": tables.stage_parts("posts", frame, parts)})


def diff(before, after):
    """By plain dicts."""
    out = [("insert", *r) for k, r in after.items() if k not in before] + [("delete", *r) for k, r in before.items() if k not in after]
    return sorted(out + [("update", *r) for k, r in after.items() if k in before and before[k] != r], key=str)


def test_change_feed_reads_changed_parts_alone(spark, tmp_path):
    tables = Snapshots(spark, f"file://{tmp_path}/t")
    rows = {i: (i, i % 7, None if i % 3 else "x") for i in range(300)} | {None: (None, 1, "no id")}
    in_part = {r["id"]: r["p"] for r in spark.createDataFrame(list(rows.values()), SCHEMA).select("id", part_of("id").alias("p")).collect()}
    write(tables, list(rows.values()), sorted(set(in_part.values())))
    one = tables.newest()
    touched = sorted({in_part[5], in_part[None], in_part[17]})
    after = {k: r for k, r in rows.items() if in_part[k] in touched}
    before = dict(after)
    after[5] = (5, 99, None)
    after[None] = (None, 2, "no id")
    del after[17]
    new = next(i for i in range(1000, 3000) if spark.range(1).select(F.pmod(F.xxhash64(F.lit(i).cast("bigint")), F.lit(64)).alias("p")).first().p in touched)
    after[new] = (new, 0, "new")
    write(tables, list(after.values()), touched)
    found = changes.between(tables, "posts", ["id"], one, tables.newest(), SCHEMA)
    assert sorted([(r.change, r.id, r.score, r.label) for r in found.collect()], key=str) == diff(before, after)
    read = {f.rsplit("_part=", 1)[1].split("/")[0] for f in found.inputFiles()}
    assert read == {str(p) for p in touched} and len(touched) < len(set(in_part.values())) / 10
    got = changes.feed(tables, "posts", ["id"], one, SCHEMA).collect()
    assert {r.change for r in got} == {"insert", "update", "delete"} and {r.version for r in got} == {tables.newest()}
    beat = changes.feed(tables, "posts", ["id"], tables.newest(), SCHEMA).collect()
    assert [(r.change, r.version, r.id) for r in beat] == [("heartbeat", tables.newest(), None)]
    write(tables, list(after.values()), touched)  # written again, nothing changed
    assert [r.change for r in changes.feed(tables, "posts", ["id"], tables.newest() - 1, SCHEMA).collect()] == ["heartbeat"]
    assert len(changes.feed(tables, "posts", ["id"], 0, SCHEMA).collect()) == len(rows) + 4  # from nothing: all rows, then what changed
    with pytest.raises(LookupError):
        for _ in range(4):
            write(tables, list(after.values()), touched)
        changes.feed(tables, "posts", ["id"], one, SCHEMA)


def test_feed_stream_goes_on_from_its_cursor(spark, address, tmp_path):  # noqa: F811
    spark.dataSource.register(feeds.FeedSource)
    seen, calls = {}, []

    def keep(batch, batch_id):
        calls.append(batch_id)
        ids = [r.id for r in batch.collect()]
        if len(calls) == 3:
            raise RuntimeError("lost in the middle of a batch")
        seen[batch_id] = ids

    def run():
        stream = spark.readStream.format("paged_feed").options(url=address, tags="many", pages="4").load()
        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(60)

    for _ in range(9):
        try:
            run()
        except Exception as e:  # noqa: BLE001  the stream's own
            assert "lost in the middle" in str(e)
    found = [i for ids in seen.values() for i in ids]
    assert sorted(found) == list(range(37, 100)) and calls.count(calls[2]) == 2


def test_reader_keeps_to_its_offsets_when_the_feed_grows(monkeypatch):
    newest = [100]

    def page(base, params):
        first = params["older"] or newest[0] + 1
        ids = [i for i in range(first - 1, first - 4, -1) if i > 80]
        return {"items": [{"id": i, "promoted": i} for i in ids], "atEnd": not ids or ids[-1] == 81}

    monkeypatch.setattr(feeds, "fetch_page", page)
    reader = feeds.FeedStreamReader({"url": "", "pages": "2"})
    start = reader.initialOffset()
    end = reader.latestOffset()
    newest[0] = 104  # the pages shift before a task reads them
    first = [r[0] for p in reader.partitions(start, end) for r in reader.read(p)]
    assert first == [100, 99, 98, 97, 96, 95]
    again = feeds.FeedStreamReader({"url": "", "pages": "2"})
    assert [r[0] for p in again.partitions(start, json.loads(json.dumps(end))) for r in again.read(p)] == first  # the batch again after a restart
    later = feeds.FeedStreamReader({"url": "", "pages": "2"})
    assert later.partitions(end, end) == []
    assert [r[0] for p in later.partitions(end, later.latestOffset()) for r in later.read(p)] == [94, 93, 92, 91, 90, 89]


def test_frames_of_a_failed_write_are_not_read(spark, tmp_path):
    spark.dataSource.register(frames.FrameSink)
    path, schema = f"file://{tmp_path}/f", "id long, name string"
    assert frames.events(spark, path, schema).count() == 0
    rows = spark.range(100).select("id", F.concat(F.lit("n\n\ndata: "), F.col("id").cast("string")).alias("name"))
    feeds.sse_frames(rows.repartition(4)).write.format("event_frames").mode("append").save(path)
    broken = rows.repartition(4).withColumn("name", F.when(F.col("id") == 77, F.raise_error(F.lit("no")).cast("string")).otherwise(F.col("name")))
    with pytest.raises(Exception, match="no"):
        feeds.sse_frames(broken).write.format("event_frames").mode("append").save(path)
    got = frames.events(spark, path, schema).collect()
    assert sorted((r.id, r.name) for r in got) == [(i, f"n\n\ndata: {i}") for i in range(100)]
    rows.where("id < 7").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("id long, name string").parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        feeds.sse_frames(stream).writeStream.format("event_frames").option("path", path).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert frames.events(spark, path, schema).count() == 107
