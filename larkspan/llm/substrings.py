"""Removal of repeated word windows (operator 4): Rabin-Karp hashes of every window, counted in Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.blocks import asked, blocked, bucket_bits, hashes_in_several, marks_of
from larkspan.llm.common import OTHER_BASE, WORD_BASE, Words, rolling, settled, slices, total_bytes, utf8, with_columns

#: Words in a window.
WINDOW = 35
ADDED = ["n_words", "n_removed", "kept_text", "removed_spans"]


#: Low bits of a window's hash that the first round doesn't send: the second one settles what only looks repeated.
UNSENT = np.uint64(16)


def _hashes(buf: np.ndarray, offsets: np.ndarray, k: int, second: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of all windows, in the order of the texts: the first without its UNSENT bits, the second (if wanted) whole, from the other half of the words' hashes."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    for _, _, part, at in slices(buf, offsets):
        words = Words(part, at)
        if len(words.starts) >= k:
            one, two = words.wide_hashes()
            starts = words.windows(k)
            parts.append((rolling(one, k, WORD_BASE)[starts] >> UNSENT << UNSENT, rolling(two, k, OTHER_BASE)[starts] if second else parts[0][1]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, counts = np.unique(hashes, return_counts=True)
    return distinct, counts > 1


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the words that a repeated window covers.

    A window is `window` consecutive words `[^\\x20\\x09-\\x0D]+` of one text, unchanged; it's repeated
    if the same words start anywhere else too, in the same text or another. Every window of every text
    is counted; all are judged on the input. Overlapping repeated windows make one maximal interval.

    Returns the columns of docs but for text, and n_words, n_removed, kept_text (kept words joined by one
    space) and removed_spans (array of first and last word removed, from 0). Null and empty texts have no words and
    '' as kept_text; texts shorter than a window stay whole; repeated rows repeat each other's windows;
    columns of docs with those names give way; an empty table stays empty. doc_id may be null.

    Windows are counted in two rounds: what looks repeated by 48 bits of a rolling hash of half of the words' 128 bits of XXH3
    is confirmed by another, of 64 bits, from the words' other 64 bits and another base. Different windows pass both by chance once in 10**13
    windows or so.
    """
    rest = with_columns(docs, [*ADDED, "text"]).columns
    rows = docs.select(F.col("text").cast("string").alias("_text"), *[F.col(f"`{c}`") for c in rest])
    size = total_bytes(docs)[1]
    bits = bucket_bits(size // 6)
    blocks = blocked(rows, "_text", size).select("_block", "_text", *[f"`{c}`" for c in rest])
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in rest) + "n_words long, n_removed long, kept_text string, removed_spans array<array<int>>"

    def first_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return _counted(_hashes(*utf8(table.column("_text")), window, second=False)[0])

    def suspected(one: np.ndarray, answers: pa.Table) -> np.ndarray:
        distinct, place = np.unique(one, return_inverse=True)
        return marks_of(answers, distinct, bits)[0][place]

    def second_of(table: pa.Table, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        one, two = _hashes(*utf8(table.column("_text")), window)
        return _counted(two[suspected(one, answers)])

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        buf, offsets = utf8(left.column("_text"))
        one, two = _hashes(buf, offsets, window)
        first, second = (right.filter(pc.equal(right.column("_round"), k)) for k in (1, 2))
        repeated = suspected(one, first)
        distinct, place = np.unique(two[repeated], return_inverse=True)
        repeated[repeated] = marks_of(second, distinct, bits)[0][place]
        n_words, n_removed, kept, spans, seen = [], [], [], [], 0
        for i, j, part, at in slices(buf, offsets):
            words = Words(part, at)
            firsts = words.windows(window)
            hit = firsts[repeated[seen : seen + len(firsts)]]
            seen += len(firsts)
            depth = np.zeros(len(words.starts) + 1, np.int64)
            depth[hit] += 1
            np.subtract.at(depth, hit + window, 1)
            gone = np.cumsum(depth)[:-1] > 0
            text, place_of = words.joined()
            stay = np.repeat(~gone, np.diff(place_of))
            raw = text[stay].tobytes()
            ends = np.concatenate([[0], np.cumsum(stay)])[place_of[words.first]]
            totals = np.concatenate([[0], np.cumsum(gone)])[words.first]
            for k in range(j - i):
                a, b = int(words.first[k]), int(words.first[k + 1])
                n_words.append(b - a)
                n_removed.append(int(totals[k + 1] - totals[k]))
                kept.append(raw[ends[k] : max(ends[k], ends[k + 1] - 1)])
                if n_removed[-1]:
                    marks = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]])))
                    spans.append([[int(x), int(y) - 1] for x, y in marks.reshape(-1, 2)])
                else:
                    spans.append([])
        out = {c: left.column(c) for c in rest}
        out |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "removed_spans": pa.array(spans, pa.list_(pa.list_(pa.int32())))}
        return pa.table(out)

    first = settled(asked(blocks, first_of, hashes_in_several, bits), "suspected-windows")
    second = asked(blocks, second_of, hashes_in_several, bits, first)
    answers = first.withColumn("_round", F.lit(1)).unionByName(second.withColumn("_round", F.lit(2)))
    return blocks.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(remove, schema)
