"""Schemas of the tables and records. Never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The tables' columns.
DDL = {
    "users": "id int, name string, email string, password string, level int, created_at timestamp_ntz, deleted_at timestamp_ntz",
    "posts": "id int, url string, uploaded_filename string, filename string, thumbnail_filename string, content_type string, score int, user_level int, filter string, p_hash_0 bigint, p_hash_1 bigint, p_hash_2 bigint, p_hash_3 bigint, user_name string, created_at timestamp_ntz, deleted_at timestamp_ntz, dirty boolean, released boolean, width int, height int",
    "comments": "id int, content string, score int, user_name string, post_id int, created_at timestamp_ntz, deleted_at timestamp_ntz, parent_id int",
    "post_votes": "post_id int, user_id int, vote smallint",
    "comment_votes": "comment_id int, user_id int, vote smallint",
    "post_tag_votes": "post_tag_id int, user_id int, vote smallint",
    "tags": "id int, name string, user_level int",
    "post_tags": "id int, post_id int, tag_id int, user_id int, score int",
    "messages": "id int, kind string, from_name string, to_name string, subject string, body string, read_at timestamp_ntz, created_at timestamp_ntz, ref_post_id int, ref_comment_id int",
    "invitations": "token string, created_by int, used_by int, created_at timestamp_ntz, used_at timestamp_ntz",
}

#: A page of the external feed, and the records of the queue.
FEED_PAGE = "items array<struct<id:bigint,promoted:bigint,image:string,thumb:string,fullsize:string,audio:boolean,mark:int,user:string>>, atEnd boolean, atStart boolean"
QUEUE_ITEM = "post_id int, filename string, thumbnail_filename string, job_key string"
QUEUE_STATUS = "pending int, total int, processed int, imported int, failed int, running boolean, rate_per_sec double, eta_sec int"


def conformed(rows: DataFrame, table: str) -> DataFrame:
    """rows with the columns and types of a table, in its order; columns that rows lack are null."""
    return rows.select([(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(DDL[table])])
