"""Token-id files with random access to every token (operator 2).

A file holds the ids of some documents as directly addressable codes. Level 0 has the lowest byte of
every id and a bit for each that tells whether the id goes on; level 1 has the next byte of those that
do, and so on. A rank directory (set bits before every 512th bit) leads from a position in one level
to its position in the next, so a token is read without decoding any other.

File, little-endian: magic `LDAC0001`, then unsigned 64-bit counts of documents, tokens and levels;
document ids (signed 64-bit) and a byte each that tells a null id; ends of the documents in tokens
(64-bit); then for each level the number of its codes (64-bit), the codes (a byte each), the bitmap
(bits from the lowest, padded to 8 bytes) and the directory (64-bit).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.common import scratch, settled, utf8
from larkspan.llm.tokens import END, encoder, vocabulary

MAGIC = b"LDAC0001"
#: Bits that one entry of a rank directory covers.
RANK_BITS = 512
#: A task closes a file when it has so many tokens (a longer document is whole, alone).
FILE_TOKENS = 2_000_000


def pack(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        levels.append(((rest & 0xFF).astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> 8
    out = [MAGIC, np.array([len(doc_ids), len(ids), len(levels)], "<u8").tobytes()]
    out += [np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), ends.astype("<i8").tobytes()]
    for codes, more in levels:
        bits = np.packbits(more, bitorder="little").tobytes()
        blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        out += [np.array([len(codes)], "<u8").tobytes(), codes.tobytes(), bits + bytes(-len(bits) % 8), (np.cumsum(blocks) - blocks).astype("<i8").tobytes()]
    return b"".join(out)


class Reader:
    """Reads a file's documents and single tokens from its bytes."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        docs, self.n_tokens, n_levels = (int(x) for x in np.frombuffer(data, "<u8", 3, 8))
        at = 32
        ids = np.frombuffer(data, "<i8", docs, at)
        nulls = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.ends = np.frombuffer(data, "<i8", docs, at + 9 * docs)
        self.doc_ids = [None if null else int(d) for d, null in zip(ids, nulls, strict=True)]
        at += 17 * docs
        self.levels = []
        for _ in range(n_levels):
            n = int(np.frombuffer(data, "<u8", 1, at)[0])
            codes = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            size = -(-((n + 7) // 8) // 8) * 8
            bits = np.frombuffer(data, np.uint8, size, at)
            blocks = -(-n // RANK_BITS)
            self.levels.append((codes, bits, np.frombuffer(data, "<i8", blocks, at + size)))
            at += size + 8 * blocks

    def token(self, i: int) -> int:
        """The id at position i, from one code in each level that it reaches."""
        value = 0
        for level, (codes, bits, directory) in enumerate(self.levels):
            value |= int(codes[i]) << 8 * level
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            ahead = np.unpackbits(bits[block * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_BITS]
            i = int(directory[block]) + int(ahead.sum())
        return value

    def tokens(self, a: int, b: int) -> np.ndarray:
        """The ids from position a to before b: in each level one run of codes, found by rank."""
        codes, bits, directory = self.levels[0]
        out = codes[a:b].astype(np.uint32)
        where = np.arange(b - a)
        for level in range(1, len(self.levels)):
            if not len(where):
                break
            block = a // RANK_BITS
            marks = np.unpackbits(bits[block * RANK_BITS // 8 : (a + len(where) + 7) >> 3], bitorder="little")
            skip = a - block * RANK_BITS
            here = marks[skip : skip + len(where)].astype(bool)
            a = int(directory[block]) + int(marks[:skip].sum()) if block < len(directory) else 0
            where = where[here]
            codes, bits, directory = self.levels[level]
            out[where] |= codes[a : a + len(where)].astype(np.uint32) << 8 * level
        return out


def write(docs: DataFrame, folder: str, path: str, end: int = END, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the ids of docs (doc_id, text; null text: empty) into files under `folder`, in ascending doc_id order.

    Null doc_ids come first; rows of one doc_id follow each other by the first 32 characters of their texts, then by a hash of these. Returns a row for each file:
    ordinal (its place in that order), file, n_docs, n_tokens. A task that runs twice writes under
    another name, and only the name of the one that succeeded is in the result. `folder` is a URI that
    pyarrow.fs opens (file, s3, gs, hdfs, abfs).
    """

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        context = TaskContext.get()
        system, root = FileSystem.from_uri(folder)
        system.create_dir(root)
        encode, part, made = encoder(path), context.partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal made
            ids = [d for x, _, _ in held for d in x]
            sizes = np.concatenate([n for _, n, _ in held])
            flat = np.concatenate([f for _, _, f in held])
            name = f"part-{part:07d}-{made:05d}-{context.taskAttemptId()}.dac"
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(pack(ids, np.cumsum(sizes), flat))
            held.clear()
            made += 1
            return pa.RecordBatch.from_pydict({"ordinal": pa.array([part << 32 | made], pa.int64()), "file": [name], "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([len(flat)], pa.int64())})

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for i, j, flat, at in encode.batches(*utf8(batch.column("text")), end):
                held.append((doc_ids[i:j], np.diff(at), flat))
                if sum(len(f) for _, _, f in held) >= file_tokens:
                    yield close()
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # An id, or no id, may have a third of all rows: ranges are cut between its texts too, by keys that are short however long these are.
    keys = [F.col("doc_id"), F.substring("text", 1, 32), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    return settled(ordered.mapInArrow(write_part, "ordinal long, file string, n_docs long, n_tokens long"), "token-files")


def read(files: DataFrame, folder: str) -> DataFrame:
    """The documents of the files, from the files: doc_id, start (ids of all documents before it), n_tokens, ids (binary, unsigned 32-bit)."""

    def read_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        system, root = FileSystem.from_uri(folder)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with system.open_input_file(f"{root}/{file}") as source:
                    reader = Reader(source.read())
                begins = np.concatenate([[0], reader.ends[:-1]])
                raw = [reader.tokens(a, b).astype("<u4").tobytes() for a, b in zip(begins.tolist(), reader.ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(reader.doc_ids, pa.int64()), "start": pa.array(start + begins, pa.int64()), "n_tokens": pa.array(reader.ends - begins, pa.int64()), "ids": pa.array(raw, pa.binary()), "ids_crc32": pa.array([zlib.crc32(r) for r in raw], pa.int64())})

    # The list of files is small (one row for millions of tokens): one task may sum it up.
    before = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    count = max(1, min(files.count(), 20_000))
    return placed.select("file", "start").repartition(count).mapInArrow(read_part, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def token_files(docs: DataFrame, folder: str | None = None, path: str | None = None) -> DataFrame:
    """Writes the files and returns what they hold (see `read`).

    Null and empty texts hold the end id alone; an empty table gives no file and no row; repeated rows
    are encoded each; other columns are left out.
    """
    folder = folder or scratch(docs.sparkSession, "tokens")
    return read(write(docs, folder, path or vocabulary()), folder)
