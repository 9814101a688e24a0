"""Kept indexes for searches: bitmaps of the posts that have a tag, and lists of the tags that have three letters in a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.labels import LABELS, visible
from larkspan.operators.feed import PAGE
from larkspan.operators.search import suggestions
from larkspan.sources.scratch import settled
from larkspan.sources.snapshots import Snapshots

#: Ids that a bitmap covers (Spark's), and bitmaps of successive ids whose rows lie in one folder.
BITS, TOGETHER = 32_768, 16
#: Ids from which on a bitmap takes less room than their places in it.
DENSE = 2_048
#: Folders over which three-letter lists are dealt.
PARTS = 64


def _id(bucket: Column, bit: Column) -> Column:
    """What Spark's bitmap_bucket_number and bitmap_bit_position were taken of."""
    return F.when(bucket > 0, (bucket - 1) * BITS + bit + 1).otherwise(bucket * BITS - bit).cast("bigint")


def ids_of(bitmaps: DataFrame) -> DataFrame:
    """id of each bit that is set in bitmaps (bucket, bits)."""
    hexed = bitmaps.select("bucket", F.hex("bits").alias("h"))
    bytes_ = hexed.select("bucket", F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("h") / 2 - 1).cast("int")), lambda i: F.conv(F.substring("h", 2 * i + 1, F.lit(2)), 16, 10).cast("int"))).alias("at", "byte")).where("byte <> 0")
    bits = bytes_.select("bucket", "at", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).where(F.call_function("getbit", F.col("byte"), F.col("k")) == 1)
    return bits.select(_id(F.col("bucket"), F.col("at") * 8 + F.col("k")).alias("id"))


class TagPostings:
    """For each tag and label, bitmaps of the visible posts that have the tag, by ranges of ids; and how many posts each bitmap has.

    Tables: counts (tag_id, label, bucket, n), read to choose the ranges of a page; bitmaps (with bits), of which a page reads its ranges alone.
    A bitmap of fewer than DENSE ids is kept as their places, so that a rare tag takes room for its posts and not for a whole range.
    """

    COUNTS, BITMAPS = "tag_id bigint, label string, bucket bigint, n bigint", "tag_id bigint, label string, bucket bigint, places array<smallint>, bits binary"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.tables = spark, Snapshots(spark, root)

    def build(self, posts: DataFrame, post_tags: DataFrame) -> None:
        """From all posts and links. Building again swaps both tables at once."""
        seen = posts.where(visible(LABELS)).select(F.col("id").alias("post_id"), "label")
        key = F.col("post_id")
        own = [F.col("tag_id").cast("bigint").alias("tag_id"), "label", F.bitmap_bucket_number(key).alias("bucket")]
        met = post_tags.select("post_id", "tag_id").join(seen, "post_id").select(*own, F.bitmap_bit_position(key).cast("smallint").alias("place"))
        names = ["tag_id", "label", "bucket"]
        lists = settled(met.groupBy(*names).agg(F.collect_set("place").alias("places")), "places")
        full = F.size("places") >= DENSE
        dense = lists.where(full).select(*names, F.explode("places").alias("place")).groupBy(*names).agg(F.bitmap_construct_agg(F.col("place").cast("bigint")).alias("bits"))
        found = lists.where(~full).unionByName(dense, allowMissingColumns=True)
        folder = self.tables.stage("bitmaps", found.withColumn("_part", F.floor(F.col("bucket") / TOGETHER)))
        parts = self.tables.parts(folder)
        whole = self.tables.load(list(parts.values()), self.BITMAPS)
        counts = self.tables.stage("counts", whole.select("tag_id", "label", "bucket", F.coalesce(F.bitmap_count("bits"), F.size("places").cast("long")).alias("n")))
        self.tables.swap({"bitmaps": parts, "counts": {"all": counts}}, replace=True)

    def page(self, tags: list[int] | DataFrame, labels: list[str], older: int | None = None, limit: int = PAGE) -> DataFrame:
        """id of the newest posts that have any of the tags (a few, or rows with an id) and one of the labels, below `older`; newest first."""
        ours = lambda rows: rows.where(F.col("tag_id").isin(tags)) if isinstance(tags, list) else rows.join(tags.select(F.col("id").cast("bigint").alias("tag_id")), "tag_id", "left_semi")
        wanted = F.col("label").isin(labels)
        below = F.lit(True) if older is None else F.col("bucket") <= F.bitmap_bucket_number(F.lit(older - 1).cast("bigint"))
        counts = ours(self.tables.read("counts", self.COUNTS).where(wanted & below))
        # A range has at least as many posts as its fullest bitmap; the topmost one may be cut by `older`.
        least = counts.groupBy("bucket").agg(F.max("n").alias("n")).orderBy(F.desc("bucket"))
        buckets, held = [], 0
        for row in least.toLocalIterator(prefetchPartitions=False):
            buckets.append(row["bucket"])
            if older is None or len(buckets) > 1:
                held += row["n"]
            if held >= limit:
                break
        files = self.tables.current().get("bitmaps", {})
        folders = [f for p, f in files.items() if int(p) in {b // TOGETHER for b in buckets}]
        rows = ours(self.tables.load(folders, self.BITMAPS).where(wanted & F.col("bucket").isin(buckets)))
        dense = ids_of(rows.where("bits IS NOT NULL").groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")))
        ids = dense.unionByName(rows.select("bucket", F.explode("places").alias("place")).select(_id(F.col("bucket"), F.col("place").cast("int")).alias("id"))).distinct()
        return (ids if older is None else ids.where(F.col("id") < older)).orderBy(F.desc("id")).limit(limit)


def grams(name: Column) -> Column:
    """All distinct three characters in a row of a name in lower case; none for shorter names."""
    low = F.lower(name)
    starts = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(3))))


class TagIndex:
    """The tags that have each three characters in a row, with their names, in folders by a hash of the three."""

    SCHEMA = "gram string, id bigint, name string"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.tables = spark, Snapshots(spark, root)

    def _part(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")

    def build(self, tags: DataFrame) -> None:
        """From tags (id, name)."""
        rows = tags.select(F.col("id").cast("bigint").alias("id"), "name").select(F.explode(grams(F.col("name"))).alias("gram"), "id", "name")
        folder = self.tables.stage("grams", rows.withColumn("_part", self._part(F.col("gram"))))
        self.tables.swap({"grams": self.tables.parts(folder)}, replace=True)

    def suggest(self, token: str, existing: list[str], tags: DataFrame, limit: int = 8) -> DataFrame:
        """What search.suggestions gives (id, name): tags that contain the token in any case and aren't there already, the first by id.

        A token of three characters or more reads the lists of one of its three characters and checks the names; it's the shortest of its
        lists, by the rows that their folders have. Shorter tokens read all tags.
        """
        parts_of = self.spark.range(1).select(F.lower(F.lit(token)).alias("t")).select(F.explode(grams(F.col("t"))).alias("gram")).select("gram", self._part(F.col("gram")).alias("part")).collect() if len(token) >= 3 else []
        if not parts_of:
            return suggestions(tags.select("id", "name"), token, existing, limit)
        files = self.tables.current().get("grams", {})
        if any(str(r["part"]) not in files for r in parts_of):
            return suggestions(tags.select("id", "name").limit(0), token, existing, limit)
        rows = lambda r: self.tables.load([files[str(r["part"])]], self.SCHEMA).where(F.col("gram") == r["gram"])
        sizes = self.tables.load(sorted({files[str(r["part"])] for r in parts_of}), self.SCHEMA).where(F.col("gram").isin([r["gram"] for r in parts_of])).groupBy("gram").count().collect()  # a row for each three characters of the token
        if len(sizes) < len(parts_of):
            return suggestions(tags.select("id", "name").limit(0), token, existing, limit)
        rarest = min(sizes, key=lambda s: (s["count"], s["gram"]))["gram"]
        return suggestions(rows(next(r for r in parts_of if r["gram"] == rarest)).select("id", "name"), token, existing, limit)
