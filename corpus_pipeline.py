"""A corpus made ready for training, in five stages: each reads what the one before wrote.

Every stage takes (spark, docs, sf_dir); docs has the columns of documents (doc_id, text, lang, source,
n_chars and any others). All but the last return these columns. Empty tables pass through as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import decontamination, lines, near_copies, packing, quality
from larkspan.llm.common import settled, table


def _as_before(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select([F.col(f"`{c}`") for c in docs.columns])


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts go (they have fewer than 50 words); null languages and sources are groups of
    their own; rows are judged one by one, so repeated rows and rows of one doc_id, null too, stay or
    go by their own texts; texts of any length are read whole.
    """
    clash = {c.lower() for c in quality.ADDED} & {c.lower() for c in docs.columns}
    if not clash:
        return _as_before(quality.quality_rules(docs).where("kept"), docs)
    safe = docs.select(F.struct("*").alias("_row"), "text", "lang", "source")
    return quality.quality_rules(safe).where("kept").select("_row.*")


def by_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one holds; n_chars follows the text.

    A null text is an empty line and becomes ''; rows of one doc_id are one document, which keeps the lines it
    holds first; rows without an id are one document after all others; so repeated rows keep the same lines.
    """
    clash = {c.lower() for c in lines.ADDED} & {c.lower() for c in docs.columns}
    if clash:
        out = lines.deduped_lines(docs.select(F.struct("*").alias("_row"), "doc_id", "text")).select("_row.*", F.col("text").alias("_new"))
        out = out.withColumn("text", F.col("_new"))
    else:
        out = lines.deduped_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return _as_before(out, docs)


def by_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8): the smallest doc_id, null after all others.

    Operator 7's SimHash search (fingerprints, trie self-join, components) brings texts together, MinHash bands do where more bits
    differ, and sets of shingles confirm both. Rows of one doc_id, and rows without one, are told apart by their texts (ties: the smaller hash of
    the text); of repeated rows one stays. Null and empty texts are copies of each other.
    """
    return _as_before(near_copies.without_copies(docs), docs)


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Rows of one doc_id, and rows without one, stay or go by their own texts, repeated rows together; null, empty and short texts contain none.
    """
    return _as_before(decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark")), docs)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens, with their ids.

    Null and empty texts are the end id alone; repeated rows and rows of one doc_id are packed each;
    null doc_ids stay null; texts of any length are cut into pieces.
    """
    return packing.packed(docs.select("doc_id", "text"), with_ids=True)


STAGES = [
    ("quality rules", by_quality),
    ("line dedup", by_lines),
    ("near duplicates", by_near_duplicates),
    ("benchmark decontamination", by_benchmark),
    ("packing", into_sequences),
]

#: SQL can't tokenize, nor hash as the fingerprints do; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
