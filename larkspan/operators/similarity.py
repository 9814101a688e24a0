"""Near-duplicate pictures: 256-bit perceptual hashes in four words, compared by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = ["p_hash_0", "p_hash_1", "p_hash_2", "p_hash_3"]
#: Pictures closer than this many bits are duplicates.
NEAR = 50


def distance(a: list[Column], b: list[Column]) -> Column:
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0)).cast("int")


def duplicates_of(hashes: DataFrame, words: list[int], near: int = NEAR, exclude: int | None = None, exclude_zero: bool = False) -> DataFrame:
    """Rows of hashes nearer than `near` to one hash, nearest first; without the row itself, unfinished ones (dirty, if there's such a column) and, if wanted, rows without a hash."""
    d = distance([F.col(w) for w in WORDS], [F.lit(w).cast("long") for w in words])
    rows = hashes.where(F.col("id") != exclude) if exclude is not None else hashes
    if "dirty" in hashes.columns:
        rows = rows.where("NOT dirty")
    if exclude_zero:
        rows = rows.where(" OR ".join(f"{w} <> 0" for w in WORDS))
    return rows.withColumn("distance", d).where(F.col("distance") < near).orderBy("distance", "id")


#: Pictures in a block where all pairs are compared.
BLOCK = 20_000
#: Chunks of a hash that an index takes as keys, and bits in each.
CHUNKS, WIDTH = 16, 16
#: Pairs that a task gives away at a time.
GIVEN = 100_000


def near_pairs(ids: np.ndarray, words: np.ndarray, split: int, near: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of hashes (words: four rows of words) nearer than `near`, with their distances: those before `split` with those from there on, or with a split of 0 all.

    A band of two words decides first: few pairs of a near threshold are within it there, and only these have the other band compared.
    """
    xor, one, two = np.empty(len(ids), np.uint64), np.empty(len(ids), np.uint8), np.empty(len(ids), np.uint8)
    for a in range(split or len(ids)):
        start = split or a + 1
        n = len(ids) - start
        for word, count in ((0, one), (1, two)):
            np.bitwise_xor(words[word, start:], words[word, a], out=xor[:n])
            np.bitwise_count(xor[:n], out=count[:n])
        np.add(one[:n], two[:n], out=one[:n])
        b = np.flatnonzero(one[:n] < min(near, 255))
        if len(b):
            d = one[b].astype(np.int32)
            for word in (2, 3):
                d += np.bitwise_count(words[word, start + b] ^ words[word, a])
            close = (d < near) & (ids[start + b] != ids[a])
            if close.any():
                found = ids[start + b[close]]
                yield np.minimum(found, ids[a]), np.maximum(found, ids[a]), d[close]


def _compared(batches: Iterator[pa.RecordBatch], near: int) -> Iterator[pa.RecordBatch]:
    """The pairs of blocks of one task, whose rows (_i, _j, second, id and words) lie side by side, those of the first block first."""

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        column = lambda c: rows.column(c).to_numpy()
        words = np.stack([column(w).view(np.uint64) for w in WORDS])
        made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        split = 0 if rows.column("_i")[0].as_py() == rows.column("_j")[0].as_py() else rows.num_rows - int(column("second").sum())
        if split == rows.num_rows or split == 0 and column("second").any():
            return  # one of two blocks is empty
        for found in near_pairs(column("id"), words, split, near):
            made.append(found)
            held += len(found[0])
            if held >= GIVEN:
                yield given(made)
                made, held = [], 0
        if made:
            yield given(made)

    def given(made: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], names=["a_id", "b_id", "distance"])

    group, parts = None, []
    for batch in batches:
        i, j = (batch.column(c).to_numpy() for c in ("_i", "_j"))
        cuts = [0, *(np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start == end:
                continue
            if (i[start], j[start]) != group:
                if parts:
                    yield from pairs(pa.Table.from_batches(parts))
                group, parts = (i[start], j[start]), []
            parts.append(batch.slice(start, end - start))
    if parts:
        yield from pairs(pa.Table.from_batches(parts))


def near_duplicates(hashes: DataFrame, near: int = NEAR) -> DataFrame:
    """All pairs (a_id < b_id) nearer than `near`: exact for every threshold.

    All pairs are compared, in blocks: there are as many as rows need, and so many that their pairs keep all cores busy. Each pair of blocks is a
    group of at most two blocks' rows, so no side is broadcast or held whole. Keys can't do better at these thresholds: with 49 of
    256 bits, the 784 keys a picture at the least that leave no pair out (16-bit chunks and their neighbours) still bring together
    one pair of random hashes in twenty, as rows of a join.
    """
    rows = hashes.select(F.col("id").cast("long").alias("id"), *[F.col(w).cast("long").alias(w) for w in WORDS]).na.drop()
    n = max(isqrt(2 * hashes.sparkSession.sparkContext.defaultParallelism) + 1, -(-hashes.count() // BLOCK))
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    # A block meets each other one in one group, the lower block first there, and itself.
    met = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = met.select(F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") > F.col("_other")).cast("int").alias("second"), "id", *WORDS)
    met = met.repartition(n * (n + 1) // 2, "_i", "_j").sortWithinPartitions("_i", "_j", "second")
    pairs = met.mapInArrow(partial(_compared, near=near), "a_id long, b_id long, distance int")
    kind = hashes.schema["id"].dataType
    return pairs.select(F.col("a_id").cast(kind).alias("a_id"), F.col("b_id").cast(kind).alias("b_id"), "distance")


def near_duplicates_banded(hashes: DataFrame, near: int = NEAR) -> DataFrame:
    """The same pairs, for thresholds of up to 64 bits: those at which a band of two words leaves nearly no pair over for the other band."""
    if near > 64:
        raise ValueError("two words leave too many pairs beyond 64 differing bits")
    return near_duplicates(hashes, near)
