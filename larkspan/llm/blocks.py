"""Counting hashes of all documents exactly, with few bytes moved.

Rows go to blocks by a hash of their id, their text and the partition they come from, so neither one id
(or null) nor one text fills a block. A block sends each distinct hash of its documents once,
to the bucket that owns the hash's leading bits; hashes of one block and bucket travel together, in
ascending order, as planes of bytes (the leading planes compress well). A bucket answers each block
with a bit or two for each hash. So a frequent hash costs one entry a block, not one a document, no task
gets more than its block or bucket, and the answer is nearly free to move.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text in a block, and hashes in a bucket, on average.
BLOCK_BYTES, BUCKET_HASHES = 4 << 20, 1 << 20
SENT = "_bucket int, _block long, _hashes binary, _again binary"
ANSWER = "_bucket int, _block long, _marks binary"


def blocked(docs: DataFrame, text: str, size: int) -> DataFrame:
    """docs (with doc_id and this column of text) and their _block, of so many that each has about BLOCK_BYTES of `size`."""
    return docs.withColumn("_block", F.pmod(F.xxhash64("doc_id", text, F.spark_partition_id()), F.lit(max(1, -(-size // BLOCK_BYTES)))))


def bucket_bits(hashes: int) -> int:
    """Leading bits that name a bucket: 64 buckets at least."""
    return max(6, (max(1, hashes) // BUCKET_HASHES).bit_length())


def sent(block: int, hashes: np.ndarray, again: np.ndarray, bits: int) -> pa.Table:
    """A row for each bucket; hashes: distinct, ascending; again: those that count as repeated in this block alone."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    names, begins = np.unique(bucket, return_index=True)
    ends = [*begins[1:].tolist(), len(hashes)]
    rows = [(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, ::-1].T.tobytes(), np.packbits(r).tobytes()) for a, b in zip(begins.tolist(), ends, strict=False) for h, r in ((hashes[a:b], again[a:b]),)]
    return pa.table({"_bucket": pa.array(names, pa.int32()), "_block": pa.array([block] * len(names), pa.int64()), "_hashes": pa.array([r[0] for r in rows], pa.binary()), "_again": pa.array([r[1] for r in rows], pa.binary())})


def opened(table: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(block, hashes, again) of a bucket's rows, by block."""
    out = []
    for block, raw, again in zip(*(table.column(c).to_pylist() for c in ("_block", "_hashes", "_again")), strict=True):
        h = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1)[::-1].T).view("<u8").ravel()
        out.append((block, h, np.unpackbits(np.frombuffer(again, np.uint8), count=len(h)).astype(bool)))
    return sorted(out, key=lambda x: x[0])


def answered(bucket: int, marks: list[tuple[int, np.ndarray]]) -> pa.Table:
    """marks: for each block its answers, a row of bits for each question."""
    return pa.table({"_bucket": pa.array([bucket] * len(marks), pa.int32()), "_block": pa.array([b for b, _ in marks], pa.int64()), "_marks": pa.array([np.packbits(m.ravel()).tobytes() for _, m in marks], pa.binary())})


def marks_of(table: pa.Table, hashes: np.ndarray, bits: int, questions: int = 1) -> np.ndarray:
    """The bits that the buckets gave for a block's distinct ascending hashes: a row for each question."""
    out = np.zeros((questions, len(hashes)), bool)
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    for name, raw in zip(table.column("_bucket").to_pylist(), table.column("_marks").to_pylist(), strict=True):
        a, b = (int(x) for x in np.searchsorted(bucket, [name, name + 1]))
        out[:, a:b] = np.unpackbits(np.frombuffer(raw, np.uint8), count=questions * (b - a)).reshape(questions, b - a)
    return out


def hashes_in_several(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    """A judge: marks hashes that more than one block has, or one block more than once."""
    hashes = np.sort(np.concatenate([h for _, h, _ in rows]))
    twice = np.unique(hashes[1:][hashes[1:] == hashes[:-1]])
    return [(block, again | np.isin(h, twice, assume_unique=True)) for block, h, again in rows]


def asked(blocks: DataFrame, hashes_of: Callable[..., tuple[np.ndarray, np.ndarray]], judge: Callable[[list[tuple[int, np.ndarray, np.ndarray]]], list[tuple[int, np.ndarray]]], bits: int, after: DataFrame | None = None) -> DataFrame:
    """Sends each block's hashes to their buckets; the answers (judge) by block.

    hashes_of takes a block's rows and, with `after` (the answers of a round before), the block's answers.
    """

    def send(key: tuple, *tables: pa.Table) -> pa.Table:
        return sent(key[0].as_py(), *hashes_of(*tables), bits)

    def send_one(key: tuple, table: pa.Table) -> pa.Table:
        return send(key, table)

    def send_two(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        return send(key, table, answers)

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        return answered(key[0].as_py(), judge(opened(table)))

    grouped = blocks.groupBy("_block")
    out = grouped.applyInArrow(send_one, SENT) if after is None else grouped.cogroup(after.groupBy("_block")).applyInArrow(send_two, SENT)
    return out.groupBy("_bucket").applyInArrow(answer, ANSWER)
