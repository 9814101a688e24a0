"""Token counts that follow edits (operator 10).

A document is stored as the leaves of a segment tree: runs of a few chunks (whole pre-tokens), each with its
text and its tokens; inner nodes, sums of code points and tokens, are made from the leaves' numbers when
edits come. An edit finds its leaves by descending the code points, re-encodes those leaves and one on
either side, deals the new chunks over the same leaves (over more, if there are too many) and updates
the sums above them. Leaves begin where white space follows something else, so what lies outside the
re-encoded region keeps its ids. The edited leaves are a table again: the next edits read them, and no
text is encoded twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import slices, utf8
from larkspan.llm.tokens import CHUNK, TOKEN_BYTES, Encoder, encoder, vocabulary

#: Chunks in a leaf at first (twice as many at most), and the chunks of which a worker keeps the number of ids for edits.
LEAF, KNOWN = 16, 200_000

LEAVES = "doc_id long, leaves array<string>, tokens array<int>"
EDITS = "array<struct<start:int,removed:int,added:string>>"
COUNTS = "doc_id long, n_chars long, n_tokens_before long, n_tokens long, n_edits long, n_leaves long, n_reencoded long"


class Tree:
    """Sums of code points and tokens over a document's leaves. A leaf is its text, or its place in `stored`, read when an edit needs it."""

    def __init__(self, leaves: list[str | int], chars: list[int], tokens: list[int], stored: pa.Array | None = None) -> None:
        self.leaves, self.stored = leaves or [""], stored
        self.build(chars if len(chars) else [0], tokens if len(tokens) else [0])

    def build(self, chars: list[int], tokens: list[int]) -> None:
        self.width = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = self.sums(chars), self.sums(tokens)

    def sums(self, values: list[int]) -> list[int]:
        """An array of a binary tree: node i has the sum of nodes 2 i and 2 i + 1, leaves come last."""
        out = np.zeros(2 * self.width, np.int64)
        out[self.width : self.width + len(values)] = values
        level = self.width
        while level > 1:
            out[level // 2 : level] = out[level : 2 * level : 2] + out[level + 1 : 2 * level : 2]
            level //= 2
        return out.tolist()

    def of_leaves(self, sums: list[int]) -> list[int]:
        """A sum's values for each leaf."""
        return sums[self.width : self.width + len(self.leaves)]

    def text(self, leaf: int) -> str:
        found = self.leaves[leaf]
        return found if isinstance(found, str) else self.stored[found].as_py()

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds code point `at` (the last one with text, if it's beyond), and the code points before that leaf."""
        if not self.chars[1]:
            return 0, 0
        at = min(at, self.chars[1] - 1)
        i, before = 1, 0
        while i < self.width:
            i *= 2
            if at - before >= self.chars[i]:
                before += self.chars[i]
                i += 1
        return i - self.width, before

    def put(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        i = leaf + self.width
        more, count = len(text) - self.chars[i], tokens - self.tokens[i]
        while i:
            self.chars[i] += more
            self.tokens[i] += count
            i >>= 1

    def edit(self, start: int, removed: int, added: str, count: Callable[[str], int], leaf: int = LEAF) -> int:
        """Applies an edit; the code points that were encoded again."""
        start = max(0, min(start, self.chars[1]))
        stop = max(start, min(start + removed, self.chars[1]))
        first, before = self.find(start)
        last, _ = self.find(stop)
        near = next((i for i in range(first - 1, -1, -1) if self.chars[i + self.width]), None)
        if near is not None:
            first, before = near, before - self.chars[near + self.width]
        last = next((i for i in range(last + 1, len(self.leaves)) if self.chars[i + self.width]), len(self.leaves) - 1)
        old = "".join(map(self.text, range(first, last + 1)))
        region = old[: start - before] + added + old[stop - before :]
        chunks = CHUNK.findall(region)
        n = last - first + 1
        share = -(-len(chunks) // n)
        if share > 2 * leaf:
            parts = [chunks[k : k + leaf] for k in range(0, len(chunks), leaf)]
            chars, tokens = self.of_leaves(self.chars), self.of_leaves(self.tokens)
            self.leaves[first : last + 1] = ["".join(p) for p in parts]
            chars[first : last + 1] = [sum(map(len, p)) for p in parts]
            tokens[first : last + 1] = [sum(map(count, p)) for p in parts]
            self.build(chars, tokens)
        else:
            for k in range(n):
                part = chunks[k * share : (k + 1) * share]
                self.put(first + k, "".join(part), sum(map(count, part)))
        return len(region)


def counter(encode: Encoder) -> Callable[[str], int]:
    """The number of a chunk's ids, kept for the most recent chunks."""
    known: dict[str, int] = {}

    def count(chunk: str) -> int:
        if (n := known.get(chunk)) is None:
            if len(known) >= KNOWN:
                known.clear()
            n = known[chunk] = len(encode.chunk(chunk)) >> 2
        return n

    return count


def leaves_of(encode: Encoder, buf: np.ndarray, offsets: np.ndarray, leaf: int = LEAF) -> tuple[pa.Array, pa.Array]:
    """The leaves' texts and tokens of some texts, all their chunks encoded together."""
    hard = encode.hard(buf, offsets)
    entry, begins, words = encode.chunks(buf, offsets)
    size = np.concatenate([[0], np.cumsum(encode.size[entry])])
    cuts, tokens, counts = [], [], []
    for i in range(len(offsets) - 1):
        a, b = int(words.first[i]), int(words.first[i + 1])
        if hard[i] or a == b:
            chunks = CHUNK.findall(buf[offsets[i] : offsets[i + 1]].tobytes().decode())
            parts = [chunks[k : k + leaf] for k in range(0, len(chunks), leaf)]
            lengths = [len("".join(p).encode()) for p in parts]
            cuts.append(offsets[i] + np.cumsum([0, *lengths[:-1]]) if parts else np.zeros(0, np.int64))
            tokens.append(np.array([sum(len(encode.chunk(c)) >> 2 for c in p) for p in parts], np.int64))
        else:
            at = np.arange(a, b, leaf)
            cuts.append(begins[at])
            tokens.append(np.diff(np.append(size[at], size[b])))
        counts.append(len(cuts[-1]))
    rows = pa.array(np.cumsum([0, *counts]), pa.int32())
    # The leaves of all texts lie one after another in `buf`, so each ends where the next one starts.
    ends = np.concatenate([*cuts, [offsets[-1]]]).astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(buf.tobytes())]).cast(pa.string())
    return pa.ListArray.from_arrays(rows, texts), pa.ListArray.from_arrays(rows, pa.array(np.concatenate(tokens) if tokens else [], pa.int32()))


def trees(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """The leaves of docs (doc_id, text): doc_id, leaves (their texts, in order: joined they are the text) and tokens (of each).

    Null and empty texts have no leaf; repeated rows and rows of one doc_id are kept each; an empty
    table gives no row; other columns are left out. Write the result as a table; edits read it.
    """
    path = path or vocabulary()

    def cut_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for i, j, part, at in slices(*utf8(batch.column("text")), TOKEN_BYTES):
                texts, tokens = leaves_of(encode, part, at, leaf)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), texts, tokens], names=["doc_id", "leaves", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut_part, LEAVES)


def edited(rows: DataFrame, path: str | None = None, leaf: int = LEAF, with_leaves: bool = True) -> DataFrame:
    """Applies edits to trees: rows (doc_id, leaves, tokens, edits) after them, with their counts.

    `edits` is an array of (start, removed, added) in code points, each applied to what the one before
    it left. Null edits, null leaves, and null fields as 0 or '', change nothing; positions
    beyond the text mean its end, negative ones its start. Returns doc_id, n_chars and n_tokens after the edits, n_tokens_before,
    n_edits, n_leaves, n_reencoded (code points encoded again) and, if wanted, the new leaves and tokens, from which the next edits
    go on. Repeated rows are edited each; an empty table gives no row; other columns are left out.
    """
    path = path or vocabulary()
    schema = f"{COUNTS}, leaves array<string>, tokens array<int>" if with_leaves else COUNTS
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def edit_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(encoder(path))
        for batch in batches:
            leaves, tokens = batch.column("leaves"), batch.column("tokens")
            ends, numbers = np.cumsum([0, *(n or 0 for n in leaves.value_lengths().to_pylist())]), tokens.flatten().to_numpy(zero_copy_only=False)
            stored = leaves.flatten()
            if len(stored) != len(numbers):
                raise ValueError("every leaf needs its number of tokens")
            chars = pc.utf8_length(stored).to_numpy(zero_copy_only=False)
            out: list[list] = [[] for _ in range(len(names) + 2)]
            for i, (doc, edits) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("edits").to_pylist(), strict=True)):
                a, b = int(ends[i]), int(ends[i + 1])
                tree = Tree(list(range(a, b)), chars[a:b], numbers[a:b], stored)
                before, again = tree.tokens[1], 0
                for e in edits or []:
                    if e:
                        again += tree.edit(e["start"] or 0, e["removed"] or 0, e["added"] or "", count, leaf)
                n = len(tree.leaves) if tree.chars[1] else 0
                texts, sizes = ([tree.text(k) for k in range(n)], tree.of_leaves(tree.tokens)[:n]) if with_leaves else ([], [])
                for column, value in zip(out, (doc, tree.chars[1], before, tree.tokens[1], len(edits or []), n, again, texts, sizes), strict=True):
                    column.append(value)
            arrays = [pa.array(c, pa.int64()) for c in out[: len(names)]]
            if with_leaves:
                arrays += [pa.array(out[-2], pa.list_(pa.string())), pa.array(out[-1], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "leaves", "tokens"] if with_leaves else names)

    taken = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "leaves", F.col("tokens").cast("array<int>").alias("tokens"), F.col("edits").cast(EDITS).alias("edits"))
    return taken.mapInArrow(edit_part, schema)


def with_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """rows (doc_id and others, of trees say) with their rows of edits (doc_id, seq, start, removed, added) as the array that `edited` takes, by seq.

    Rows without edits get null; edits without a row, and of a null doc_id, go nowhere; edits of equal seq follow
    each other by start, removed and added (null first); null fields stay null; rows that share a doc_id get the same edits.
    The edits of one document depend on each other, so they travel together. A column `edits` of rows gives way.
    """
    one = F.struct(F.col("seq"), F.col("start"), F.col("removed"), F.col("added"))
    lists = edits.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("_edits"))
    lists = lists.select("doc_id", F.transform("_edits", lambda e: F.struct(e["start"].alias("start"), e["removed"].alias("removed"), e["added"].alias("added"))).alias("edits"))
    return rows.drop("edits").join(lists, "doc_id", "left")
