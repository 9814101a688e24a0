"""Quality rules (operator 9): fixed base rules, then thresholds that follow each language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import SPACE, Words, settled, slices, utf8, with_columns

#: Base rules: words of the shortest text, and the percentage of its words in repeated windows of three.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Below so many texts a group's quantiles say little: the thresholds of all texts hold then.
LEAST_GROUP = 100
#: How far beyond the quartiles a threshold lies, in distances between them, and the least distance counted, by measure.
FENCE = 4.0
MEASURES = {"word_length": 0.25, "symbol_share": 0.01, "dup_lines_per_word": 0.02, "repeat_share": 0.12}
#: Size of a quantile sketch (KLL: exact up to so many rows, an error of about 0.1 % of a group's rows beyond), and parts that a group's is made in.
SKETCH, SALTS = 4096, 64
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ADDED = [*STATS, "base_failed", "kept"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def stats_of(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The five counts of some texts, a column each."""
    words = Words(buf, offsets)
    rows = len(offsets) - 1
    out = np.zeros((5, rows), np.int64)
    out[0] = np.diff(words.first)
    point = np.concatenate([[0], np.cumsum(((buf & 0xC0) != 0x80) & ~SPACE[buf])])
    out[1] = np.diff(point[offsets])
    out[2] = np.diff(np.concatenate([[0], np.cumsum(_SYMBOL[buf])])[offsets])
    raw = buf.tobytes()
    for i in range(rows):
        lines = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x and not x.isspace()]
        out[3, i] = len(lines) - len(set(lines))
    starts = words.windows(3)
    if len(starts):
        word, _ = words.distinct()
        n = int(word.max()) + 1
        window = np.repeat(np.arange(rows), np.maximum(out[0] - 2, 0))
        for k in range(3):  # a number for each text and its words so far: no hash, so no clash
            window = pd.factorize(window * n + word[starts + k])[0]
        twice = (np.bincount(window) > 1)[window]
        covered = np.zeros(len(words.starts), bool)
        for k in range(3):
            covered[starts[twice] + k] = True
        out[4] = np.diff(np.concatenate([[0], np.cumsum(covered)])[words.first])
    return out


def with_stats(docs: DataFrame) -> DataFrame:
    """docs and the five counts of each whole text (null: no words)."""
    names = docs.columns

    def count_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column("text"))
            parts = [stats_of(part, at) for _, _, part, at in slices(buf, offsets)]
            stats = np.concatenate(parts, axis=1) if parts else np.zeros((5, 0), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(s, pa.int64()) for s in stats]], names=[*names, *STATS])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema) + ", ".join(f"{c} long" for c in STATS)
    return docs.mapInArrow(count_part, schema)


def base_failed() -> F.Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def _measures() -> dict[str, F.Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {"word_length": F.col("word_chars") / words, "symbol_share": F.col("n_symbols") / chars, "dup_lines_per_word": F.col("n_dup_lines") / words, "repeat_share": F.col("n_repeat_words") / words}


def thresholds_of(stats: DataFrame) -> DataFrame:
    """For each lang and source: n and, by measure, low and high: the quartiles of its sketch, FENCE distances out.

    One more row, with _all = true, holds for groups of under LEAST_GROUP rows. Sketches are made by group
    and salt and merged in two steps, so the last merge of a group reads SALTS sketches, however many tasks
    and rows a hot language or source has.
    """
    salted = stats.select("lang", "source", (F.spark_partition_id() % SALTS).alias("salt"), *[m.alias(k) for k, m in _measures().items()])
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(k).alias(k) for k in MEASURES]]
    parts = settled(salted.groupBy("lang", "source", "salt").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(k, SKETCH).alias(k) for k in MEASURES]), "sketches")
    own = parts.groupBy("lang", "source").agg(*merged).withColumn("all", F.lit(False))
    some = parts.groupBy(F.pmod(F.xxhash64("lang", "source", "salt"), F.lit(SALTS)).alias("salt")).agg(*merged)
    every = some.groupBy(F.lit(True).alias("all")).agg(*merged).select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), *["n", *MEASURES, "all"])
    out = [F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("all").alias("_all"), F.col("n").alias("_n")]
    found = own.unionByName(every)
    for k, least in MEASURES.items():
        low, high = (F.kll_sketch_get_quantile_double(k, F.lit(p)) for p in (0.25, 0.75))
        gap = F.greatest(high - low, F.lit(least)) * FENCE
        out += [(low - gap).alias(f"_low_{k}"), (high + gap).alias(f"_high_{k}")]
    return found.select(out)


def judged(stats: DataFrame, thresholds: DataFrame) -> DataFrame:
    """stats with base_failed and kept, by the thresholds of their language and source."""
    names = stats.columns
    limits = [f"_{side}_{k}" for k in MEASURES for side in ("low", "high")]
    own = thresholds.where(~F.col("_all") & (F.col("_n") >= LEAST_GROUP)).select("_lang", "_source", *limits)
    every = thresholds.where("_all").select(*limits).first()  # one row; none of an empty table
    if thresholds.count() <= 100_000:  # rows of a few numbers: some MB
        own = F.broadcast(own)
    joined = stats.join(own, stats["lang"].eqNullSafe(own["_lang"]) & stats["source"].eqNullSafe(own["_source"]), "left")
    within = F.lit(True)
    for k, m in _measures().items():
        low, high = (F.coalesce(F.col(f"_{s}_{k}"), F.lit(every[f"_{s}_{k}"] if every else None).cast("double")) for s in ("low", "high"))
        within &= m <= high
        if k == "word_length":
            within &= m >= low
    failed = base_failed()
    return joined.select(*[stats[f"`{c}`"] for c in names], failed.alias("base_failed"), (~failed & within).alias("kept"))


def quality_rules(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """docs (with text, lang, source), the five counts of each text, base_failed and kept; without text if it isn't wanted.

    Words are `[^\\x20\\x09-\\x0D]+`. n_words and word_chars count words and their code points; n_symbols
    characters of `[#*$%&|<>]`; n_dup_lines lines with a word that equal an earlier line of the text;
    n_repeat_words words in windows of three words that are found twice or more in the text. base_failed:
    fewer than 50 words, or more than half of them in repeated windows. kept: not that, and no measure
    (word length, symbols a character, repeated lines a word, share of repeated words) beyond the
    quartiles of its lang and source by more than FENCE times their distance.

    Null texts have no words; null langs and sources are groups of their own; repeated rows count each;
    columns of docs with the names of the added ones give way; an empty table stays empty. Texts are measured
    once: the counts are written to the shared folder, and thresholds and verdicts come from them.
    """
    docs = with_columns(docs, ADDED).withColumn("text", F.col("text").cast("string"))
    seen = with_stats(docs)
    seen = settled(seen if with_text else seen.drop("text"), "quality-counts")
    return judged(seen, settled(thresholds_of(seen), "thresholds"))
