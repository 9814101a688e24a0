"""Best-fit packing of whole documents into sequences (operator 13): large documents are matched in pairs, small ones fill the gaps.

Of documents above a third of a sequence at most two share one. They are matched greedily: the longest
with the longest that still fits beside it, which gives as many pairs as there can be. Smaller
documents follow, longest first, each to the sequence with the least room that holds it.

Documents of one length are alike to the packing, so it is planned on their counts: `length` numbers,
however many documents there are. The plan says which ranks among the documents of a length go where. Tasks that
tokenize number their pieces within each length; the sums of the tasks before give a piece its rank, and so
its sequence. One plan holds for the whole corpus: no task or source has a half-filled sequence of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.common import settled, utf8
from larkspan.llm.tokens import encoder, vocabulary

LENGTH, END = 1024, 2
#: Pieces of a batch that a task passes on.
ROWS = 16384


class Plan:
    """Where the pieces of each length go, from the number of pieces of each length.

    `slots`: (length of the pieces, first rank, pieces, first sequence, pieces in each sequence, offset of the first).
    Each step uses up a length or a run of sequences with the same room, and a run that takes on pieces has less than half of
    its room left, so there are some ten thousand slots at most.
    """

    def __init__(self, counts: np.ndarray, length: int = LENGTH) -> None:
        self.length, self.left = length, counts.astype(np.int64).copy()
        self.placed = np.zeros_like(self.left)
        self.sequences = 0
        self.open: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, sequences)
        self.slots: list[tuple[int, int, int, int, int, int]] = []
        self.put(length, int(self.left[length]), self.opened(int(self.left[length])), 1, 0)
        self.match()
        self.fill()

    def opened(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, size: int, n: int, first: int, each: int, offset: int) -> None:
        if n:
            self.slots.append((size, int(self.placed[size]), n, first, each, offset))
            self.placed[size] += n
            self.left[size] -= n

    def keep(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.open.setdefault(room, []).append((first, n))

    def partner(self, size: int) -> int:
        """The largest length above a third that fits beside `size`, or 0."""
        for other in range(min(size, self.length - size), self.length // 3, -1):
            if self.left[other] > (other == size):
                return other
        return 0

    def match(self) -> None:
        for size in range(self.length - 1, self.length // 3, -1):
            while n := int(self.left[size]):
                other = self.partner(size)
                if not other:
                    first = self.opened(n)
                    self.put(size, n, first, 1, 0)
                    self.keep(self.length - size, first, n)
                    continue
                n = n // 2 if other == size else min(n, int(self.left[other]))
                first = self.opened(n)
                self.put(size, n, first, 1, 0)
                self.put(other, n, first, 1, size)
                self.keep(self.length - size - other, first, n)

    def fill(self) -> None:
        for size in range(self.length // 3, 0, -1):
            while n := int(self.left[size]):
                room = min((r for r in self.open if r >= size), default=0)
                if not room:
                    room, n_new = self.length, -(-n // (self.length // size))
                    self.keep(room, self.opened(n_new), n_new)
                first, there = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room]
                each = min(n, room // size)  # as many as the least room takes stay the best fit
                full = min(there, n // each)
                self.put(size, full * each, first, each, self.length - room)
                self.keep(room - each * size, first, full)
                self.keep(room, first + full, there - full)

    def place(self, sizes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence and the offset of pieces by their length and their rank among the pieces of that length."""
        slots = np.array(sorted(self.slots), np.int64).reshape(-1, 6)
        bits = 48
        at = np.searchsorted(slots[:, 0] << bits | slots[:, 1], sizes << bits | ranks, "right") - 1
        size, first_rank, _, first, each, offset = slots[at].T
        k = ranks - first_rank
        return first + k // each, offset + k % each * size


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and part and nth (its number among the pieces of that length in its task)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)

        def rows(doc: list, piece: np.ndarray, start: np.ndarray, size: np.ndarray, raw: list[bytes]) -> pa.RecordBatch:
            order = np.argsort(size, kind="stable")
            _, first, n = np.unique(size[order], return_index=True, return_counts=True)
            nth = np.empty(len(size), np.int64)
            nth[order] = np.arange(len(size)) - np.repeat(first, n)
            nth += seen[size]
            np.add.at(seen, size, 1)
            out = {"doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(size, pa.int64()), "ids_crc32": pa.array([zlib.crc32(r) for r in raw], pa.int64()), "part": pa.array(np.full(len(size), part), pa.int64()), "nth": pa.array(nth, pa.int64())}
            return pa.RecordBatch.from_pydict(out | ({"ids": pa.array(raw, pa.binary())} if with_ids else {}))

        for batch in batches:
            doc_ids = np.array(batch.column("doc_id").to_pylist(), object)
            for i, j, flat, at in encode.batches(*utf8(batch.column("text")), end):
                total = np.diff(at)
                n = -(-total // length)
                head = total - (n - 1) * length  # the first piece has what the whole ones leave
                doc = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = np.where(piece > 0, head[doc] + (piece - 1) * length, 0)
                size = np.where(piece > 0, length, head[doc])
                raw, begin = flat.astype("<u4", copy=False).tobytes(), at[:-1][doc] + start
                ids = [raw[4 * a : 4 * (a + s)] for a, s in zip(begin.tolist(), size.tolist(), strict=True)]
                for a in range(0, len(doc), ROWS):
                    b = slice(a, a + ROWS)
                    yield rows(doc_ids[i:j][doc[b]].tolist(), piece[b], start[b], size[b], ids[b])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long" + (", ids binary" if with_ids else ""))


def best_fit(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row for each piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset; ids (binary) if asked for.

    A document of more than `length` ids (`end` after each counts) is cut: all pieces but the first have `length`.
    Null and empty texts are the end id alone; null doc_ids stay null; repeated rows and rows of one doc_id are packed
    each; documents of equal length are alike, and which of them goes where is by their order in the tasks; an empty
    table gives no row; other columns are left out.
    """
    found = settled(pieces(docs, path or vocabulary(), length, end, with_ids), "pieces", "zstd")
    by_part = settled(found.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = np.zeros(length + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # `length` rows at most
        counts[row["length"]] = row["n"]
    plan = Plan(counts, length)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = found.join(earlier, ["part", "length"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(*(batch.column(c).to_numpy() for c in ("length", "rank")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in names)
    out = ranked.select(*names, "rank").mapInArrow(assign, f"{schema}, sequence_id long, offset long")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
