"""What the operators share: reading tables, the shared scratch folder, Arrow buffers and word hashes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task hashes at a time; some dozen numbers a byte are held meanwhile.
SLICE_BYTES = 1 << 20
#: The separators of words: space and the controls 9 to 13. All are single bytes of UTF-8.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = r"[^\x20\x09-\x0D]+"

_SCRATCH: dict[int, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing on one machine (tests) is a temporary folder used; on a cluster that raises.
    The session's folder is removed when the driver ends.
    """
    context = spark.sparkContext
    key = id(context)
    if key not in _SCRATCH:
        root = context.getConf().get("spark.checkpoint.dir")
        if not root:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = f"file://{tempfile.mkdtemp(prefix='larkspan-')}"
        _SCRATCH[key] = f"{root.rstrip('/')}/larkspan-{uuid.uuid4().hex}"
        path = context._jvm.org.apache.hadoop.fs.Path(_SCRATCH[key])
        system = path.getFileSystem(context._jsc.hadoopConfiguration())

        def remove() -> None:
            try:
                system.delete(path, True)
            except Exception:  # noqa: BLE001  the JVM may be gone already; the folder is scratch
                pass

        atexit.register(remove)
    return f"{_SCRATCH[key]}/{name}-{uuid.uuid4().hex[:8]}"


def settled(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df, written to the shared folder and read again: later jobs neither repeat its work nor need its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_columns(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs without columns of these names (any case), which an operator is about to add."""
    taken = {n.lower() for n in names}
    return docs.select([docs[f"`{c}`"] for c in docs.columns if c.lower() not in taken])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (one more than rows); nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if where else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def slices(buf: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about `most` bytes; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes (multiply, shift, xor)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Odd bases of the polynomials over bytes and over words (two for these), and a random value for each byte.
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE, OTHER_BASE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
BYTE_VALUE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Words:
    """Words of some texts: where each starts and ends in `buf`, and `first`, the words before each text."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray) -> None:
        solid = ~SPACE[buf]
        opens, closes = solid.copy(), solid.copy()
        opens[1:] &= ~solid[:-1]
        closes[:-1] &= ~solid[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(buf))]
        opens[edge] = solid[edge]
        closes[edge - 1] = solid[edge - 1]
        self.buf, self.solid = buf, solid
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each word, the same for words of the same bytes; and for each number, a word that has it.

        A quick polynomial sorts words into groups; whoever's bytes differ from the first of its group gets a number by its bytes.
        """
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths = self.ends - self.starts
        inside = np.flatnonzero(self.solid)
        begins = np.cumsum(lengths) - lengths
        place = np.arange(len(inside), dtype=np.int32) - np.repeat(begins.astype(np.int32), lengths)
        letters = self.buf[inside]
        values = BYTE_VALUE[letters] * powers(BYTE_BASE, int(lengths.max()))[place]
        codes, _ = pd.factorize(mixed(np.add.reduceat(values, begins) + lengths.astype(np.uint64)))
        first = np.zeros(int(codes.max()) + 1, np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        model = first[codes]
        same = lengths == lengths[model]
        inside += np.repeat(np.where(same, self.starts[model] - self.starts, 0), lengths)
        differs = np.flatnonzero(self.buf[inside] != letters)
        same[np.searchsorted(begins, differs, "right") - 1] = False
        if not same.all():
            named: dict[bytes, int] = {}
            extra = []
            for i in np.flatnonzero(~same).tolist():
                word = self.buf[self.starts[i] : self.ends[i]].tobytes()
                if word not in named:
                    named[word] = len(first) + len(extra)
                    extra.append(i)
                codes[i] = named[word]
            first = np.concatenate([first, np.array(extra, np.int64)])
        return codes, first

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: one half of the 128 bits."""
        return self.wide_hashes()[0]

    def wide_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """XXH3 (128 bits) of each word's bytes, in two halves."""
        codes, first = self.distinct()
        raw, digest = self.buf.tobytes(), xxhash.xxh3_128_digest
        halves = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(self.starts[first].tolist(), self.ends[first].tolist(), strict=True)]), ">u8").astype(np.uint64).reshape(-1, 2)
        return halves[codes, 1], halves[codes, 0]

    def windows(self, k: int) -> np.ndarray:
        """The first words of all windows of k consecutive words of one text."""
        counts = np.maximum(np.diff(self.first) - (k - 1), 0)
        total = int(counts.sum())
        before = np.cumsum(counts) - counts
        return np.arange(total) - np.repeat(before, counts) + np.repeat(self.first[:-1], counts)

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, each with one space after it, as bytes; and where each word starts there (one more entry for the end)."""
        lengths = self.ends - self.starts + 1
        at = np.concatenate([[0], np.cumsum(lengths)])
        out = np.full(int(at[-1]), 0x20, np.uint8)
        inside = np.ones(int(at[-1]), bool)
        inside[at[1:] - 1] = False
        out[inside] = self.buf[self.solid]
        return out, at


def rolling(words: np.ndarray, k: int, base: np.uint64 = WORD_BASE) -> np.ndarray:
    """Rabin-Karp: the hash of words[i : i + k] for each i, from prefix sums of a polynomial modulo 2**64."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up = powers(base, len(words))
    down = powers(np.uint64(pow(int(base), -1, 1 << 64)), n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * up)])
    return mixed((sums[k:] - sums[:-k]) * down)


def total_bytes(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and bytes of text."""
    row = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0))).first()
    return int(row[0]), int(row[1])
