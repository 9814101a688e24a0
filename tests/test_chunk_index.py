import random

import pytest
from pyspark.sql import functions as F

from larkspan.operators import similarity
from larkspan.operators.chunk_index import ChunkIndex, masks

SCHEMA = "id bigint, p_hash_0 bigint, p_hash_1 bigint, p_hash_2 bigint, p_hash_3 bigint"


def signed(h):
    words = [(h >> 64 * i) & ((1 << 64) - 1) for i in range(4)]
    return [w - (1 << 64) if w >> 63 else w for w in words]


@pytest.fixture(scope="module")
def pictures():
    """Hashes, near copies of some at 0 to 60 bits, equal ones, and some without a hash."""
    rng = random.Random(9)
    base = [rng.getrandbits(256) for _ in range(120)]
    near = [h ^ sum(1 << b for b in rng.sample(range(256), rng.choice([0, 1, 16, 48, 49, 50, 60]))) for h in base for _ in range(2)]
    return [(i, h) for i, h in enumerate([*base, *near, *base[:5], 0, 0])]


def by_hand(pictures, near=50):
    return {(a, b): (x ^ y).bit_count() for i, (a, x) in enumerate(pictures) for b, y in pictures[i + 1 :] if x and y and (x ^ y).bit_count() < near}


def above_scan(plan):
    """What stands between the scan of the index and the join above it, and the join."""
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*|"))
    scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    chain, now = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < now - 1:
            chain.append(line)
            now = depth(line)
            if "Join" in line:
                break
    return chain


@pytest.mark.parametrize("batches", [[362], [120, 1, 100, 141]])
def test_batches_against_the_index(spark, tmp_path, pictures, batches):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        index = ChunkIndex(spark, f"file://{tmp_path}/i", buckets=4)
        found, at = [], 0
        for n in [*batches, len(pictures) - sum(batches)]:
            part = spark.createDataFrame([(i, *signed(h)) for i, h in pictures[at : at + n]], SCHEMA)
            at += n
            new = index.add(part)
            links = index.links(new)
            found += [(r.a_id, r.b_id, r.distance) for r in links.collect()]
        chain = above_scan(links._jdf.queryExecution().executedPlan().toString())
        assert "SortMergeJoin" in chain[-1] and not any("Exchange" in node for node in chain), chain
        members = {}
        for r in index.table("members").collect():
            members.setdefault(r.class_id, []).append(r.id)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) == len({x[:2] for x in found})
    pairs = {(min(x, y), max(x, y)): d for a, b, d in found for x in members[a] for y in members[b]}
    pairs |= {(x, y): 0 for m in members.values() for x in m for y in m if x < y}
    assert pairs == by_hand(pictures)
    frame = spark.createDataFrame([(i, *signed(h)) for i, h in pictures if h], SCHEMA)
    assert pairs == {(r.a_id, r.b_id): r.distance for r in similarity.near_duplicates_banded(frame, 50).collect()}
    index.drop()


def test_masks():
    assert len(masks(3)) == 697 and len(set(masks(3))) == 697 and max(m.bit_count() for m in masks(3)) == 3


def test_lookups_are_not_broadcast(spark, tmp_path, pictures):
    """Thousands of lookups for each class must not pass through the driver, however small the classes are."""
    index = ChunkIndex(spark, f"file://{tmp_path}/i", buckets=4)
    links = index.links(index.add(spark.createDataFrame([(i, *signed(h)) for i, h in pictures], SCHEMA)))
    assert "SortMergeJoin" in above_scan(links._jdf.queryExecution().executedPlan().toString())[-1]
    index.drop()


@pytest.mark.parametrize("near", [1, 5, 16, 17, 49, 50, 64, 80])
def test_reaches_leave_no_pair_out(near):
    """However differing bits lie over the chunks, one chunk has no more than its reach."""
    from larkspan.operators.similarity import CHUNKS

    reaches = [r for k in range(CHUNKS) if (r := (near + CHUNKS - 1 - k) // CHUNKS - 1) >= 0]
    assert sum(r + 1 for r in reaches) == near
