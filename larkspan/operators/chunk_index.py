"""A stored index of perceptual hashes: new pictures against all there are, without reading or moving the index whole.

Hashes are classes: pictures with the same 256 bits are one row and its members. A class has 16 rows, one for each chunk of 16 bits, in a
table bucketed by place and value of the chunk. A pair has one chunk that differs in no more bits than the chunk's reach, if the reaches and one more for each
chunk come to the threshold; so new classes are looked up by their chunks and those chunks' neighbours, and only these lookups are shuffled; the index is read where its buckets lie.
"""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators.similarity import CHUNKS, NEAR, WIDTH, WORDS, distance

#: Buckets of an index: what one task reads of it.
BUCKETS = 64


def chunk_at(words: list[Column], k: Column) -> Column:
    """Chunk k (from 0) of a hash: 16 bits, the lowest of the first word first."""
    word = F.element_at(F.array(*words), F.floor(k / 4).cast("int") + 1)
    return F.call_function("shiftrightunsigned", word, (k % 4 * WIDTH).cast("int")).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def masks(reach: int) -> list[int]:
    """All chunks with up to `reach` bits."""
    return [sum(1 << b for b in bits) for n in range(reach + 1) for bits in combinations(range(WIDTH), n)]


class ChunkIndex:
    """Tables of the session's catalog, in a folder: chunks (bucketed), classes (class_id and its words) and members (class_id, id)."""

    def __init__(self, spark: SparkSession, root: str, near: int = NEAR, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.near, self.buckets = spark, root.rstrip("/"), near, buckets
        #: Bits that may differ in each chunk: together, and one more for each chunk, they come to the threshold.
        self.reaches = [r for k in range(CHUNKS) if (r := (near + CHUNKS - 1 - k) // CHUNKS - 1) >= 0]
        if near > 5 * CHUNKS:
            raise ValueError("the chunk index serves up to 80 differing bits")
        self.name = f"chunks_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {self.name} (class_id bigint, k int, x int, {', '.join(f'{w} bigint' for w in WORDS)}) USING parquet CLUSTERED BY (k, x) SORTED BY (k, x) INTO {buckets} BUCKETS LOCATION '{self.root}/chunks'")
        for part, columns in (("classes", f"class_id bigint, {', '.join(f'{w} bigint' for w in WORDS)}"), ("members", "class_id bigint, id bigint")):
            self.spark.sql(f"CREATE TABLE {self.name}_{part} ({columns}) USING parquet LOCATION '{self.root}/{part}'")

    def table(self, part: str = "") -> DataFrame:
        return self.spark.table(f"{self.name}_{part}" if part else self.name)

    def add(self, hashes: DataFrame) -> DataFrame:
        """Takes in pictures (id and words; each id once) and gives the classes that are new: class_id (the smallest id of the batch) and words. Pictures without a hash (all zero) are left out."""
        rows = hashes.select(F.col("id").cast("bigint").alias("id"), *WORDS).where(" OR ".join(f"{w} <> 0" for w in WORDS))
        batch = rows.groupBy(*WORDS).agg(F.min("id").alias("_first"))
        known = batch.join(self.table("classes"), WORDS, "left").select(*WORDS, "_first", "class_id", F.coalesce("class_id", "_first").alias("_class"))
        staged = f"{self.root}/batches/{uuid.uuid4().hex}"
        known.write.parquet(staged)  # the same classes for all three tables
        known = self.spark.read.parquet(staged)
        new = known.where("class_id IS NULL").select(F.col("_class").alias("class_id"), *WORDS)
        own = rows.join(known.select(*WORDS, "_class"), WORDS).select(F.col("_class").alias("class_id"), "id")
        own.write.insertInto(f"{self.name}_members")
        cut = new.select("class_id", F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))).alias("k"), *WORDS)
        cut = cut.select("class_id", "k", chunk_at([F.col(w) for w in WORDS], F.col("k")).alias("x"), *WORDS)
        cut.repartition(self.buckets, "k", "x").write.insertInto(self.name)  # a file for each bucket of a batch
        new.write.insertInto(f"{self.name}_classes")
        return new

    def links(self, classes: DataFrame) -> DataFrame:
        """Pairs of classes nearer than the threshold of which one at least is of `classes` (class_id, words; in the index): a_id < b_id, distance. Each pair once."""
        ours = classes.select(F.col("class_id").alias("_a"), *[F.col(w).alias(f"a_{i}") for i, w in enumerate(WORDS)])
        words_a = [F.col(f"a_{i}") for i in range(4)]
        if not self.reaches:
            return ours.limit(0).select(F.col("_a").alias("a_id"), F.col("_a").alias("b_id"), F.lit(0).alias("distance"))
        # The first chunks reach one bit farther than the others.
        reach = lambda k: F.when(k < self.reaches.count(self.reaches[0]), self.reaches[0]).otherwise(self.reaches[-1])
        near_masks = F.when(reach(F.col("k")) == self.reaches[0], F.lit(masks(self.reaches[0]))).otherwise(F.lit(masks(self.reaches[-1])))
        dealt = ours.repartition(self.buckets, "_a")  # few rows in, thousands of lookups out of each
        asked = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(self.reaches) - 1)))).withColumn("_own", chunk_at(words_a, F.col("k")))
        asked = asked.withColumn("x", F.explode(F.transform(near_masks, lambda m: F.col("_own").bitwiseXOR(m.cast("int"))))).drop("_own")
        # Spark takes what an explode makes for as small as what it was made of, and would broadcast thousands of lookups for each class.
        met = asked.hint("merge").join(self.table(), ["k", "x"]).where("_a <> class_id")
        words_b = [F.col(w) for w in WORDS]
        apart = lambda k: F.bit_count(chunk_at(words_a, k).bitwiseXOR(chunk_at(words_b, k)))
        first = ~F.exists(F.sequence(F.lit(0), F.lit(CHUNKS - 1)), lambda k: (k < F.col("k")) & (apart(k) <= reach(k)))  # of the chunks in which a pair meets
        pairs = met.withColumn("distance", distance(words_a, words_b)).where((F.col("distance") < self.near) & first)
        # Of two of `classes` each finds the other: one of both counts.
        both = classes.select(F.col("class_id").alias("_b"))
        found = pairs.select("_a", "class_id", "distance").join(both, F.col("class_id") == F.col("_b"), "left").where("_b IS NULL OR _a < class_id")
        return found.select(F.least("_a", "class_id").alias("a_id"), F.greatest("_a", "class_id").alias("b_id"), "distance")

    def drop(self) -> None:
        for part in ("", "_classes", "_members"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}{part}")
