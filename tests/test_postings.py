import random

import pytest
from pyspark.sql import functions as F

from larkspan.operators import search
from larkspan.operators.postings import TagIndex, TagPostings, grams, ids_of
from larkspan.plans import registry
from larkspan.plans import views as v


def test_bits_give_back_their_ids(spark):
    ids = [-70000, -32768, -5, 0, 1, 2, 32767, 32768, 32769, 65536, 65537, 10**9]
    frame = spark.createDataFrame([(i,) for i in ids], "id bigint")
    bitmaps = frame.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    assert sorted(r.id for r in ids_of(bitmaps).collect()) == sorted(ids)


def test_pages_of_postings(spark, tmp_path):
    rng = random.Random(5)
    ids = sorted(rng.sample(range(2_000_000), 3000))
    posts = spark.createDataFrame([(i, rng.choice(["sfw", "nsfp", "nsfw"]), i % 17 == 0, i % 11 > 0, i % 13 == 0) for i in ids], "id bigint, label string, dirty boolean, released boolean, deleted boolean")
    links = spark.createDataFrame([(i, t) for i in ids for t in rng.sample(range(6), 2)], "post_id bigint, tag_id int")
    tags = spark.createDataFrame([(t, f"t{t}") for t in range(6)], "id int, name string")
    index = TagPostings(spark, f"file://{tmp_path}/p")
    index.build(posts, links)
    for wanted, labels in (([1], ["sfw"]), ([0, 3, 5], ["sfw", "nsfp"]), ([9], ["sfw"])):
        every = [r.id for r in search.by_tags(posts, links, tags, [f"t{t}" for t in wanted], labels).select("id").collect()]
        assert [r.id for r in index.page(wanted, labels).collect()] == every[:50]
        seen, older = [], None
        for _ in range(3):
            page = index.page(wanted, labels, older)
            found = [r.id for r in page.collect()]
            seen += found
            if not found:
                break
            assert len({f.split("_part=")[1].split("/")[0] for f in page.inputFiles()}) <= 3  # of some four
            older = found[-1]
        assert seen == every[:150]
    assert index.page([1], ["sfw"], older=ids[0]).count() == 0


@pytest.mark.parametrize("token", ["nvi", "NVI", "ea", "", "antique", "zzz", "qqqq", "e l", "Äö"])
def test_suggestions_through_the_index(spark, data, tmp_path, token):
    tags = v.named_tags(spark, f"{data}/sf0.001").unionByName(spark.createDataFrame([(90001, "äöü nvi"), (90002, "x"), (90003, ""), (90004, None)], "id bigint, name string"))
    index = TagIndex(spark, f"file://{tmp_path}/g")
    index.build(tags)
    want = search.suggestions(tags, token, ["äöü NVI"]).select("id", "name").collect()
    got = index.suggest(token, ["äöü NVI"], tags)
    assert got.collect() == want
    if token.lower() == "nvi":
        assert len({f.split("_part=")[1].split("/")[0] for f in got.inputFiles()}) == 1


def test_grams(spark):
    frame = spark.createDataFrame([("AbcAbC",), ("ab",), ("",), (None,)], "n string")
    assert [r[0] for r in frame.select(grams(F.col("n"))).collect()] == [["abc", "bca", "cab"], [], [], []]


def test_queries_equal_what_they_take_over(spark, data):
    sf = f"{data}/sf0.01"
    assert registry.QUERIES["directory_page"](spark, sf).count() == 50 and registry.QUERIES["search_tags_postings"](spark, sf).count() == 50


def test_rare_tags_take_the_room_of_their_posts(spark, tmp_path):
    """A tag of one post in a range has a place there and no bitmap of the range; a frequent one has the bitmap. Pages mix both."""
    posts = spark.range(-100, 70_000, 1).select("id", F.lit("sfw").alias("label"), F.lit(False).alias("dirty"), F.lit(True).alias("released"), F.lit(False).alias("deleted"))
    links = spark.range(-100, 70_000, 1).select(F.col("id").alias("post_id"), F.when(F.col("id") % 9 == 0, 1).otherwise(F.col("id") + 1000).alias("tag_id"))
    index = TagPostings(spark, f"file://{tmp_path}/p")
    index.build(posts, links)
    rows = index.tables.read("bitmaps", index.BITMAPS)
    assert rows.where("tag_id > 1 AND (bits IS NOT NULL OR size(places) <> 1)").isEmpty() and rows.where("tag_id = 1 AND bits IS NOT NULL").count() == 2
    assert [r.id for r in index.page([1, 68_000, 69_001, -50 + 1000], ["sfw"], older=68_002, limit=5).collect()] == [68_001, 67_995, 67_986, 67_977, 67_968]
    assert [r.id for r in index.page([950, 980], ["sfw"]).collect()] == [-20, -50]
