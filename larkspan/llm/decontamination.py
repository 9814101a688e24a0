"""Benchmark decontamination (operator 6), with DataFrame functions only: MinHash containment by size, exact verification.

A document contains an item if at least 0.8 of the item's distinct five-word shingles are in it. Then
of any n - ceil(0.8 n) + 1 of the item's n shingles at least one is. So an item is searched by its MinHash
sketch, its so many lowest shingle hashes; items fall into partitions by size (1, 2-3, 4-7, ... shingles),
and a partition's largest size gives the length of its sketches. Every shingle of every document is
looked up among the sketches; what is found is verified on the shingles themselves. Nothing is lost,
however long the document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import settled

SHINGLE, CONTAINED = 5, 0.8
#: Sketch entries (a number and an id each) and bytes of items that may be broadcast.
MOST_ENTRIES, MOST_ITEM_BYTES = 1_000_000, 32 << 20
#: Groups over which documents are dealt where sketches aren't broadcast.
SALTS = 16


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _each(text: str, value: Callable[[list[Column]], Column]) -> Column:
    """An array with `value` of the five words of each shingle of a text column; null if it has fewer words.

    The words are bound by a lambda, so they are split once a text and not once a shingle.
    """

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - SHINGLE)
        return F.when(F.size(w) >= SHINGLE, F.transform(starts, lambda i: value([F.get(w, i + k) for k in range(SHINGLE)])))

    return F.get(F.transform(F.array(words(F.col(text))), of), F.lit(0))


def hashes(text: str) -> Column:
    return _each(text, lambda w: F.xxhash64(*w))


def shingles(text: str) -> Column:
    return _each(text, lambda w: F.concat_ws(" ", *w))


def _found_by_shuffle(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """doc_id, text and item_id where a document and an item's sketch share a hash, for sketches beyond what may be broadcast.

    Only ids and hashes meet; the texts come after, for what was found. A hash may be in a third of all
    documents, so those are dealt over SALTS groups, and each sketch entry goes to all of them.
    """
    named = docs.withColumn("_name", F.xxhash64("text"))
    salt = F.pmod(F.xxhash64("doc_id", "_name"), F.lit(SALTS)).cast("int")
    looked_up = named.select("doc_id", "_name", salt.alias("_salt"), F.explode(F.array_distinct(hashes("text"))).alias("hash"))
    entries = sketches.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = looked_up.join(entries.hint("shuffle_merge"), ["hash", "_salt"]).select(F.col("doc_id").alias("_doc"), F.col("_name").alias("_of"), "item_id").distinct()
    return named.join(pairs, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_name") == F.col("_of"))).select("doc_id", "text", "item_id").distinct()


def _pairs(docs: DataFrame, benchmark: DataFrame, share: float) -> DataFrame:
    """doc_id, text_hash (Spark's xxhash64), item_id, n_shared, n_shingles and containment for each row of docs and item it contains; repeated rows once or more."""
    items = benchmark.select("item_id", F.array_distinct(shingles("text")).alias("item"), F.array_sort(F.array_distinct(hashes("text"))).alias("h")).where("size(item) > 0").distinct()
    items = settled(items.withColumn("class", F.floor(F.log2(F.size("item")))), "items")
    # of a class's largest items, of 2 ** (class + 1) - 1 shingles, so many may be missing and one more
    missing = F.floor((F.pow(F.lit(2.0), F.col("class") + 1) - 1) * (1 - share) + 1e-9).cast("int")
    sketches = settled(items.select("item_id", F.explode(F.slice("h", 1, F.least(missing + 1, F.size("h")))).alias("hash")), "sketches")
    entries, held = sketches.count(), items.agg(F.coalesce(F.sum(F.octet_length(F.array_join("item", " "))), F.lit(0))).first()[0]
    if entries <= MOST_ENTRIES:
        looked_up = docs.select("doc_id", "text", F.explode(hashes("text")).alias("hash"))
        found = looked_up.join(F.broadcast(sketches), "hash").select("doc_id", "text", "item_id").distinct()
    else:
        found = _found_by_shuffle(docs.select("doc_id", "text"), sketches)
    exact = items.select(F.col("item_id").alias("_item_id"), "item")
    if held <= MOST_ITEM_BYTES:
        exact = F.broadcast(exact)
    shared = found.join(exact, F.col("item_id").eqNullSafe(F.col("_item_id"))).select("doc_id", F.xxhash64("text").alias("text_hash"), "item_id", F.size(F.array_intersect(shingles("text"), "item")).alias("n_shared"), F.size("item").alias("n_shingles"))
    return shared.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("n_shared") >= F.col("n_shingles") * share - 1e-9)


def contained(docs: DataFrame, benchmark: DataFrame, share: float = CONTAINED) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles (of the item, distinct) and containment, for each document and item it contains.

    docs: doc_id, text; benchmark: item_id, text. Words are runs of letters and digits in lower case, so
    case, punctuation and line breaks don't matter. Null or short texts (under five words) have no
    shingle: such items are in no document. Rows of one doc_id are told apart by their text; repeated rows
    and null ids give one pair; empty tables give none; other columns are left out.
    """
    out = _pairs(docs, benchmark, share)
    return out.groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n_shared").alias("n_shared"), F.max("containment").alias("containment")).select("doc_id", "item_id", "n_shared", "n_shingles", "containment")


def decontaminated(docs: DataFrame, benchmark: DataFrame, share: float = CONTAINED) -> DataFrame:
    """docs without the rows whose text contains an item.

    Rows of one doc_id, and rows without one, are told apart by their texts, so a clean row stays beside one that goes; repeated rows go together.
    """
    found = _pairs(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, share)
    gone = settled(found.select(F.col("doc_id").alias("_leak"), F.col("text_hash").alias("_hash")).distinct(), "leaks")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_own"))
    return rows.join(gone, F.col("_id").eqNullSafe(F.col("_leak")) & (F.col("_own") == F.col("_hash")), "left_anti").select("_row.*")
