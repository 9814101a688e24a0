"""Registered queries through what is kept ready: rank directories, bitmaps of tags, lists of three letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.functions import labels
from larkspan.operators.chunk_index import ChunkIndex
from larkspan.operators.postings import TagIndex, TagPostings
from larkspan.operators.ranks import RankDirectory
from larkspan.plans import views as v
from larkspan.plans.registry import COPIES, LABELS, ORACLE_SQL, POST, SEEN, copies, query
from larkspan.sources.scratch import folder


@query("directory_page", f"SELECT id, (SELECT count(*) FROM posts WHERE {SEEN} AND id > {POST}) AS position FROM (SELECT id, row_number() OVER (ORDER BY id DESC) AS n FROM posts WHERE {SEEN}) WHERE n BETWEEN 1001 AND 1050", "posts")
def directory_page(spark, d):
    """Page 21 of the feed and a post's place, from the ranges that they lie in."""
    directory = RankDirectory(spark, folder(spark, "ranks"), most=2000)
    directory.build(v.posts(spark, d).where(labels.visible(LABELS)).select("id"))
    return directory.page(21).crossJoin(F.broadcast(directory.position(POST)))  # one row


@query("search_tags_postings", f"SELECT id FROM (SELECT DISTINCT p.id FROM posts p JOIN post_tags x ON x.post_id = p.id JOIN tags t ON t.id = x.tag_id WHERE t.name IN ('Brand#11', 'Brand#23') AND {SEEN} AND p.id < {POST}) ORDER BY id DESC LIMIT 50", "posts", "post_tags", "tags")
def search_tags_postings(spark, d):
    """A page of a search by tags, from the bitmaps of the ranges that it lies in."""
    index = TagPostings(spark, folder(spark, "postings"))
    index.build(v.posts(spark, d), v.post_tags(spark, d))
    return index.page(v.tags(spark, d).where(F.col("name").isin("Brand#11", "Brand#23")), LABELS, POST)  # names repeat: there are more such tags in larger tables


@query("tag_suggest_index", ORACLE_SQL["tag_suggest"])
def tag_suggest_index(spark, d):
    tags = v.named_tags(spark, d)
    index = TagIndex(spark, folder(spark, "grams"))
    index.build(tags)
    existing = [r[0] for r in tags.where("id IN (1, 10)").select("name").collect()]  # the names that a post has, a few
    return index.suggest("NVI", existing, tags)


@query("near_duplicates_index", f"""WITH {COPIES}, classes AS (SELECT min(id) AS id, b FROM bits WHERE list_contains(b, true) GROUP BY b)
    SELECT a.id AS a_id, b.id AS b_id, CAST(list_sum(list_transform(list_zip(a.b, b.b), lambda x: CASE WHEN x[1] <> x[2] THEN 1 ELSE 0 END)) AS INT) AS distance FROM classes a JOIN classes b ON a.id < b.id WHERE b.id >= 10000000 AND distance < 50
    UNION ALL SELECT c.id, bits.id, 0 FROM bits JOIN classes c ON c.b = bits.b WHERE bits.id >= 10000000""")
def near_duplicates_index(spark, d):
    """New pictures against a stored index with the threshold of production: pairs of classes, and of each new picture its class (distance 0)."""
    index = ChunkIndex(spark, folder(spark, "chunks"))
    pictures = v.hashes(spark, d)
    index.add(pictures)
    new = index.add(copies(pictures))
    own = index.table("members").where("id >= 10000000")
    return index.links(new).unionByName(own.select(F.col("class_id").alias("a_id"), F.col("id").alias("b_id"), F.lit(0).alias("distance")))
