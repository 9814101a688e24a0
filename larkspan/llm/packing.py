"""Packing of documents into training sequences (operator 3).

A sequence costs `linear` for each token plus `quadratic` times the square of each piece's length
(attention inside a document). Whole stretches of 1024 ids fill a sequence each. The rest of each
document goes, longest first, to the cheapest sequence that still has room for it. As many sequences
are open as the tokens of a block need, the last ones with powers of two as lengths, so nothing is
padded; a piece that fits nowhere whole is cut at the room of the cheapest sequence.

Blocks are runs of documents of one task: a task packs what it reads, with bounded memory and without
a shuffle, however many tokens one source or group has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.tokens import END, encoder, vocabulary
from larkspan.llm.common import utf8

LENGTH = 1024
#: Cost of a token, and of a token's attention to another: about 1 to 6 times the width of a model of 1024.
LINEAR, QUADRATIC = 1.0, 1.0 / 6144
#: Rests of documents that are packed together at most.
BLOCK = 8192

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n: np.ndarray | int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray | float:
    return linear * n + quadratic * n * n


def rooms(total: int, length: int = LENGTH) -> np.ndarray:
    """Lengths of the sequences that hold `total` tokens without padding: full ones, then powers of two."""
    rest = total % length
    return np.array([length] * (total // length) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1], np.int64)


def balanced(sizes: np.ndarray, length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(item, start in the item, length, sequence, offset there) for items shorter than a sequence."""
    room = rooms(int(sizes.sum()), length)
    size, spent, out = room.copy(), np.zeros(len(room)), []
    for item in np.argsort(-sizes, kind="stable").tolist():
        start, left = 0, int(sizes[item])
        while left:
            fits = np.where(room >= left, spent, np.inf)
            best = int(fits.argmin())
            if fits[best] == np.inf:
                best = int(np.where(room > 0, spent, np.inf).argmin())
            n = min(left, int(room[best]))
            out.append((item, start, n, best, int(size[best] - room[best])))
            room[best] -= n
            spent[best] += cost(n, linear, quadratic)
            start, left = start + n, left - n
    return out


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = False, block: int = BLOCK, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """A row for each piece of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ids (binary) if asked for.

    Null and empty texts are the end id alone; null doc_ids stay null; repeated rows are packed each; of rests of equal
    length the one that comes first in its task goes first; an empty table gives no row; other columns are left out. `length` must be a power of two.
    """
    path = path or vocabulary()

    def pack_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, next_id = encoder(path), TaskContext.get().partitionId() << 36
        rests: list[tuple] = []

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            doc, start, raw, tokens, sequence, offset = zip(*pieces, strict=True) if pieces else [()] * 6
            out = {"doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array([len(r) >> 2 for r in raw], pa.int64()), "ids_crc32": pa.array([zlib.crc32(r) for r in raw], pa.int64()), "doc_tokens": pa.array(tokens, pa.int64()), "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())}
            return pa.RecordBatch.from_pydict(out | ({"ids": pa.array(raw, pa.binary())} if with_ids else {}))

        def flush() -> pa.RecordBatch:
            nonlocal next_id
            sizes = np.array([len(r[2]) >> 2 for r in rests], np.int64)
            pieces = [(rests[i][0], rests[i][1] + s, rests[i][2][4 * s : 4 * (s + n)], rests[i][3], next_id + q, o) for i, s, n, q, o in balanced(sizes, length, linear, quadratic)]
            next_id += len(rooms(int(sizes.sum()), length))
            rests.clear()
            return rows(pieces)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for i, j, flat, at in encode.batches(*utf8(batch.column("text")), end):
                whole, raw = [], flat.astype("<u4", copy=False).tobytes()
                for k in range(i, j):
                    a, b = int(at[k - i]), int(at[k - i + 1])
                    for s in range(a, b, length):
                        piece = (doc_ids[k], s - a, raw[4 * s : 4 * min(s + length, b)], b - a)
                        if s + length <= b:
                            whole.append((*piece, next_id, 0))
                            next_id += 1
                        else:
                            rests.append(piece)
                    if len(rests) >= block:
                        yield flush()
                yield rows(whole)
        if rests:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pack_part, PIECES + (", ids binary" if with_ids else ""))
