"""Stand-ins for the board's tables over the test tables, as DataFrames and, for the oracle, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    label = F.when(status == "F", "sfw").when(status == "O", "nsfp").when(key % 5 == 0, "secret").otherwise("nsfw")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.col("o_custkey").alias("user_id"), label.alias("label"), F.col("o_orderdate").alias("created_at"), (key % 17 == 0).alias("dirty"), (key % 11 != 0).alias("released"), (key % 13 == 0).alias("deleted"), (key % 23 - 7).alias("score")
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    level = F.when(seg == "BUILDING", 10).when(seg == "MACHINERY", 5).when(seg == "HOUSEHOLD", 0).otherwise(1)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), level.alias("level"))


def post_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("post_id"), F.col("l_partkey").alias("tag_id"), F.col("l_quantity").cast("int").alias("score"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))


def named_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes_of(table(spark, sf_dir, "events"))


def votes_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    vote = F.when(kind.isin("view", "click"), 1).when(kind == "error", -1).when(kind == "purchase", 0).when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    entity = F.get_json_object("props", "$.k").cast("long")
    return events.select(F.col("event_id").alias("seq"), "ts", "user_id", entity.alias("entity"), vote.alias("vote"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    n = events.agg((F.max("user_id") + 1).alias("_n"))  # one row
    kind = F.when(F.col("event_type") == "signup", "system").when(F.col("event_type") == "error", "notification").otherwise("private")
    rows = events.crossJoin(F.broadcast(n)).select(
        F.col("event_id").alias("id"), kind.alias("kind"), F.col("user_id").alias("from_id"), ((F.col("user_id") * 7 + F.col("event_id")) % F.col("_n")).alias("to_id"), F.col("event_type").alias("body"), (F.col("event_id") % 3 != 0).alias("is_read"), F.col("ts").alias("created_at"),
        F.get_json_object("props", "$.k").cast("long").alias("ref_post_id"), (F.get_json_object("props", "$.k").cast("long") * 100).alias("ref_comment_id"),
    )
    return rows.where("from_id <> to_id")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    parent = F.when(turn > 0, F.col("conv_id") * 100 + F.floor((turn - 1) / 2).cast("long"))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + turn).alias("id"), F.col("conv_id").alias("post_id"), parent.alias("parent_id"), F.col("role").alias("user"), F.col("text").alias("content"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def word(k: int):
        # a bit for each dimension, the lowest first
        bits = [F.expr(f"CASE WHEN embedding[{i}] > embedding[{(i + k + 1) % 64}] THEN shiftleft(1L, {i}) ELSE 0L END") for i in range(64)]
        out = bits[0]
        for b in bits[1:]:
            out = out.bitwiseOR(b)
        return out.alias(f"p_hash_{k}")

    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[word(k) for k in range(4)])


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    vis = F.when(e % 3 == 0, "global").when(e % 3 == 1, "user").otherwise("role")
    status = F.when(e % 5 == 0, "pending").when(e % 5 == 1, "running").when(e % 5 == 2, "failed").otherwise("done")
    return table(spark, sf_dir, "events").select(
        e.alias("id"), vis.alias("visibility"), F.col("user_id").alias("owner_user_id"), (e % 11).cast("int").alias("min_role_level"), (e % 101).cast("int").alias("progress"), F.lit(100).alias("total"), (e % 37).cast("int").alias("elapsed"), status.alias("status"), F.col("ts").alias("created_at")
    )


SQL = {
    "posts": "SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_orderstatus = 'F' THEN 'sfw' WHEN o_orderstatus = 'O' THEN 'nsfp' WHEN o_orderkey % 5 = 0 THEN 'secret' ELSE 'nsfw' END AS label, o_orderdate AS created_at, o_orderkey % 17 = 0 AS dirty, o_orderkey % 11 <> 0 AS released, o_orderkey % 13 = 0 AS deleted, o_orderkey % 23 - 7 AS score FROM orders",
    "users": "SELECT c_custkey AS id, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 10 WHEN 'MACHINERY' THEN 5 WHEN 'HOUSEHOLD' THEN 0 ELSE 1 END AS level FROM customer",
    "post_tags": "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS post_id, l_partkey AS tag_id, CAST(trunc(l_quantity) AS INT) AS score FROM lineitem",
    "tags": "SELECT p_partkey AS id, p_brand AS name FROM part",
    "named_tags": "SELECT p_partkey AS id, p_name AS name FROM part",
    "votes": "SELECT event_id AS seq, ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS entity, CASE WHEN event_type IN ('view', 'click') THEN 1 WHEN event_type = 'error' THEN -1 WHEN event_type = 'purchase' THEN 0 WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS vote FROM events",
    "messages": "SELECT * FROM (SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 'system' WHEN 'error' THEN 'notification' ELSE 'private' END AS kind, user_id AS from_id, (user_id * 7 + event_id) % (SELECT max(user_id) + 1 FROM events) AS to_id, event_type AS body, event_id % 3 <> 0 AS is_read, ts AS created_at, CAST(json_extract_string(props, '$.k') AS BIGINT) AS ref_post_id, CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 AS ref_comment_id FROM events) WHERE from_id <> to_id",
    "comments": "SELECT conv_id * 100 + turn AS id, conv_id AS post_id, CASE WHEN turn > 0 THEN conv_id * 100 + (turn - 1) // 2 END AS parent_id, role AS \"user\", text AS content FROM conversations",
    "jobs": "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'user' ELSE 'role' END AS visibility, user_id AS owner_user_id, CAST(event_id % 11 AS INT) AS min_role_level, CAST(event_id % 101 AS INT) AS progress, 100 AS total, CAST(event_id % 37 AS INT) AS elapsed, CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'done' END AS status, ts AS created_at FROM events",
    "bits": "SELECT vec_id AS id, list_transform(generate_series(0, 255), lambda i: embedding[i % 64 + 1] > embedding[(i % 64 + i // 64 + 1) % 64 + 1]) AS b FROM embeddings",
}


def with_views(query: str, *names: str) -> str:
    """A query over stand-ins, for DuckDB."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + query
