"""Alignment of two tokenizers' tokens of the same texts (operator 12).

A text is encoded by a byte-level BPE and by a byte-fallback piece model; both lists of tokens cover the same bytes.
The ends of the shorter list are searched in the longer one by galloping (exponential, then binary
search). Ends in both lists cut a document into groups; the difference of the ranks of two successive
ends tells which tokens of the other list a token overlaps, so each overlapping pair, a link, is met once.

How often a pair of ids is linked is counted over the whole corpus. A block of documents
passes on each pair once, with its number of links, and gets back the corpus's number for it, so a pair that all documents
have costs one row a block; a block's links are kept as places in its own list of pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import settled, slices, utf8
from larkspan.llm.tokens import VOCABULARY, Encoder, vocabulary

PIECES = "piece_bpe_32k.model"
#: Bytes of text whose pairs are counted together, and pairs in a row of them.
BLOCK_BYTES, PAIR_ROWS = 8 << 20, 1 << 15
#: Bytes of text that a task aligns at a time; some hundred bytes for each are held meanwhile.
SLICE_BYTES = 1 << 19
#: The sign for a space in pieces; a token that isn't the bytes it comes from.
SPACE_SIGN, OTHER = "▁", 0xFFFFFFFF
RETURN = 0x0D

KEPT = "_block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs array<long>, counts array<long>, first int"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class PieceEncoder(Encoder):
    """Encodes texts that begin with the space which the piece model puts before a text.

    A piece has spaces only at its beginning, and no white space but U+000D stands in a piece with
    other characters; so chunks (see tokens) have the same pieces alone as in a text without U+000D.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.pieces = SentencePieceProcessor(model_file=path)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.raw = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(names)]
        self.alone = names.index(SPACE_SIGN)
        self.start()

    def chunk(self, chunk: str) -> bytes:
        if chunk[0] == " ":
            ids = self.pieces.encode(chunk[1:]) if len(chunk) > 1 else [self.alone]
        else:
            ids = self.pieces.encode(chunk)
            if ids[:1] == [self.alone]:
                ids = ids[1:]
        if b"".join([self.raw[i] for i in ids]) != chunk.encode():
            ids = [OTHER]
        return np.array(ids, "<u4").tobytes()

    def slowly(self, text: str) -> np.ndarray:
        return np.frombuffer(self.chunk(text), np.uint32)

    def hard(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = super().hard(buf, offsets)
        out[np.searchsorted(offsets, np.flatnonzero(buf == RETURN), "right") - 1] = True
        return out

    def lengths(self) -> np.ndarray:
        return np.array([len(r) for r in self.raw], np.int64)


class ByteEncoder(Encoder):
    """Encodes texts by the byte-level BPE; strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        super().__init__(path, plain_specials=True)

    def lengths(self) -> np.ndarray:
        names = self.tokenizer.get_vocab()
        out = np.zeros(max(names.values()) + 1, np.int64)
        out[list(names.values())] = [len(t) for t in names]  # a character stands for a byte
        return out


_ENCODERS: dict[tuple[str, str], tuple] = {}


def encoders(path_a: str, path_b: str) -> tuple[ByteEncoder, PieceEncoder, np.ndarray, np.ndarray]:
    """Both encoders and the bytes of each of their tokens; one set for each worker process."""
    key = path_a, path_b
    if key not in _ENCODERS:
        a, b = ByteEncoder(path_a), PieceEncoder(path_b)
        _ENCODERS[key] = a, b, a.lengths(), b.lengths()
    return _ENCODERS[key]


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of `short` the first place in `long` whose value isn't less; both ascend, and long's last is at least short's.

    Places of every 2**k-th value come first, then those halfway between, down to neighbours. Each search
    starts at the place of its neighbour on the left, doubles its reach until it's past the value and halves the last reach.
    """
    n = len(short)
    at = np.zeros(n, np.int64)
    stride = 1 << max(0, (n - 1).bit_length())
    rounds = [np.arange(0, min(n, 1))]
    while stride := stride >> 1:
        rounds.append(np.arange(stride, n, 2 * stride))
    for k, which in enumerate(rounds):
        if not len(which):
            continue
        left = which - (1 << (len(rounds) - 1 - k)) if k else which
        base = at[left] if k else np.zeros(1, np.int64)
        value, last = short[which], len(long) - 1
        reach = np.zeros(len(which), np.int64)  # long[base + reach // 2] is less, long[base + reach] isn't
        todo = np.flatnonzero(long[base] < value)
        step = 1
        while len(todo):
            reach[todo] = step
            todo = todo[long[np.minimum(base[todo] + step, last)] < value[todo]]
            step *= 2
        low, high = base + np.where(reach, reach // 2 + 1, 0), np.minimum(base + reach, last)
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) // 2
            less = long[middle] < value[todo]
            low[todo[less]] = middle[less] + 1
            high[todo[~less]] = middle[~less]
            todo = todo[low[todo] < high[todo]]
        at[which] = high
    return at


def overlaps(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By ends of tokens: which of `short` are in long too, and where there; the first token of long that each of short overlaps, and how many it does."""
    rank = gallop(short, long)
    common = long[rank] == short if len(short) else np.zeros(0, bool)
    first = np.concatenate([[0], rank[:-1] + common[:-1]]).astype(np.int64) if len(short) else rank
    return common, rank[common], first, rank - first + 1


#: The decimal digits of numbers below 65536, from the lowest byte of a 64-bit number on, and how many there are.
_NUMBERS = [str(i).encode() for i in range(1 << 16)]
DIGITS = np.array([int.from_bytes(s, "little") for s in _NUMBERS], np.uint64)
N_DIGITS = np.array([len(s) for s in _NUMBERS], np.uint8)


def grouped_text(a: np.ndarray, b: np.ndarray, common_a: np.ndarray, common_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of `a1,a2|b1;a3|b2;` over all groups, and where the text of each group ends there.

    common_a, common_b: which tokens end a group.
    """
    last_a, last_b = np.flatnonzero(common_a), np.flatnonzero(common_b)
    groups = len(last_a)
    group_a, group_b = np.cumsum(common_a) - common_a, np.cumsum(common_b) - common_b
    before_b = np.concatenate([[0], last_b[:-1] + 1]) if groups else last_b
    ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint64)
    place_a, place_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + (last_a + 1)[group_b]
    ids[place_a], ids[place_b] = a, b
    mark[place_a[last_a]], mark[place_b[last_b]] = ord("|"), ord(";")
    if len(ids) and ids.max() >= 1 << 16:
        raise ValueError("vocabularies of up to 65,536 tokens only")
    n = N_DIGITS[ids].astype(np.uint64)
    cells = (DIGITS[ids] | mark << (n * np.uint64(8))).view(np.uint8).reshape(-1, 8)
    out = cells[np.arange(8, dtype=np.uint64) <= n[:, None]]
    return out, np.cumsum(n + np.uint64(1)).astype(np.int64)[place_b[last_b]]


def aligned(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Of documents whose tokens stand at at_a and at_b: groups and links of each, the hash of its groups, and the ids of all links, document after document.

    In all these documents A has at most as many tokens as B: its ends are searched among B's.
    """
    common_a, in_b, first, count = overlaps(ends_a, ends_b)
    common_b = np.zeros(len(ids_b), bool)
    common_b[in_b] = True
    links_before = np.concatenate([[0], np.cumsum(count)])
    to_b = np.arange(int(links_before[-1])) + np.repeat(first - links_before[:-1], count)
    return common_a, common_b, np.diff(links_before[at_a]), np.repeat(ids_a, count), ids_b[to_b]


def spread(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of some documents, and where each of these documents starts among them."""
    n = np.diff(at)[which]
    new = np.concatenate([[0], np.cumsum(n)])
    return np.arange(int(new[-1])) + np.repeat(at[:-1][which] - new[:-1], n), new


class Aligned:
    """What a run of texts gives: for each its tokens, groups, links and hash, and its links' ids."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, tools: tuple) -> None:
        encode_a, encode_b, bytes_a, bytes_b = tools
        (a, at_a), (b, at_b) = encode_a.encode(buf, offsets), encode_b.encode(buf, offsets)
        texts = len(offsets) - 1
        other = np.zeros(texts, bool)
        other[np.searchsorted(at_b, np.flatnonzero(b == OTHER), "right") - 1] = True
        n_a, n_b = np.diff(at_a), np.diff(at_b)
        self.n_a, self.n_b = np.where(other, 0, n_a), np.where(other, 0, n_b)
        self.n_groups, self.n_links = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
        self.hashes, links = [""] * texts, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * texts
        for turned in (False, True):  # the list with fewer ends drives the search
            which = np.flatnonzero((n_a > n_b if turned else n_a <= n_b) & ~other & (n_a > 0))
            if not len(which):
                continue
            (place_a, own_a), (place_b, own_b) = spread(at_a, which), spread(at_b, which)
            ids_a, ids_b = a[place_a].astype(np.int64), b[place_b].astype(np.int64)
            ends_a, ends_b = np.cumsum(bytes_a[ids_a]), np.cumsum(bytes_b[ids_b])
            if (ends_a[own_a[1:] - 1] != ends_b[own_b[1:] - 1]).any():
                raise ValueError("tokens don't cover their text")
            if turned:
                common_b, common_a, n_links, link_b, link_a = aligned(ids_b, ids_a, ends_b, ends_a, own_b, own_a)
            else:
                common_a, common_b, n_links, link_a, link_b = aligned(ids_a, ids_b, ends_a, ends_b, own_a, own_b)
            groups = np.concatenate([[0], np.cumsum(common_a)])[own_a]
            text, group_ends = grouped_text(ids_a, ids_b, common_a, common_b)
            ends = group_ends[groups[1:] - 1]
            begins = np.concatenate([[0], ends[:-1]])
            raw = text.tobytes()
            at = np.concatenate([[0], np.cumsum(n_links)])
            self.n_groups[which], self.n_links[which] = np.diff(groups), n_links
            for i, s, e, x, y in zip(which.tolist(), begins.tolist(), (ends - 1).tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                self.hashes[i] = hashlib.sha256(raw[s:e]).hexdigest()
                links[i] = link_a[x:y], link_b[x:y]
        self.pairs = np.concatenate([x for x, _ in links] or [np.zeros(0, np.int64)]) << 32 | np.concatenate([y for _, y in links] or [np.zeros(0, np.int64)])


def spaced(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each with a space in front unless it's empty."""
    there = np.diff(offsets) > 0
    return np.insert(buf, offsets[:-1][there], 0x20), offsets + np.concatenate([[0], np.cumsum(there)])


def planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as four planes of bytes, the lowest first: the upper ones are mostly zeros and compress to little."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def of_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def linked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document (pairs: null), and rows with each block's pairs and the links of each (doc_id and all else: null)."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tools, block = encoders(path_a, path_b), TaskContext.get().partitionId() << 24
        held: list[tuple[list, Aligned]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block
            codes, pairs = pd.factorize(np.concatenate([x.pairs for _, x in held]))
            counts = np.bincount(codes, minlength=len(pairs))
            order = np.argsort(-counts, kind="stable")  # frequent pairs get small numbers
            place = np.empty(len(pairs), np.int64)
            place[order] = np.arange(len(pairs))
            codes, pairs, counts = place[codes], pairs[order], counts[order]
            begin = 0
            for ids, x in held:
                at = begin + np.concatenate([[0], np.cumsum(x.n_links)])
                begin = int(at[-1])
                links = [planes(codes[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                n, none = len(ids), pa.nulls
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array(ids, pa.int64()), *(pa.array(v, pa.int64()) for v in (x.n_a, x.n_b, x.n_groups, x.n_links)), pa.array(x.hashes, pa.string()), pa.array(links, pa.binary()), none(n, pa.list_(pa.int64())), none(n, pa.list_(pa.int64())), none(n, pa.int32())], names=NAMES)
            for i in range(0, len(pairs), PAIR_ROWS):
                row = [[block], [None], [None], [None], [None], [None], [None], [None], [pairs[i : i + PAIR_ROWS]], [counts[i : i + PAIR_ROWS]], [i]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, TYPES, strict=True)], names=NAMES)
            held.clear()
            block += 1

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, j, part, at in slices(*utf8(batch.column("text")), SLICE_BYTES):
                held.append((ids[i:j], Aligned(*spaced(part, at), tools)))
                size += len(part)
                if size >= BLOCK_BYTES:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(link, KEPT)


NAMES = [c.split()[0] for c in KEPT.split(", ")]
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
TYPES = [_TYPES[c.split()[1]] for c in KEPT.split(", ")]


def pair_counts(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From `linked`: each block's pairs with their places, and each pair's links in the corpus, with the most that its B id has with any A id."""
    each = found.where("pairs IS NOT NULL").select("_block", "first", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "x"))
    each = each.select("_block", (F.col("first") + F.col("at")).alias("place"), F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    counts = settled(each.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))  # a row for each piece of the vocabulary at most
    return each, counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "count", "most", (F.col("pair") - F.col("b")).alias("a_high"), "b")


def links_of_ids(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """a_id, b_id, n_links and is_best (no A id has more links with that B id) for each pair of ids linked anywhere in docs."""
    counts = pair_counts(settled(linked(docs, path_a or vocabulary(VOCABULARY), path_b or vocabulary(PIECES)), "links", "zstd"))[1]
    return counts.select(F.shiftright("a_high", 32).cast("int").alias("a_id"), F.col("b").cast("int").alias("b_id"), F.col("count").alias("n_links"), (F.col("count") == F.col("most")).alias("is_best"))


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A null or empty text, and one whose pieces aren't its bytes (it holds U+2581), has no tokens: zeros and ''. Repeated rows, rows of one
    doc_id and null ids are texts of their own, and all their links count; other columns are left out; an empty table gives no row.
    """
    found = settled(linked(docs, path_a or vocabulary(VOCABULARY), path_b or vocabulary(PIECES)), "links", "zstd")
    each, counts = pair_counts(found)
    answers = each.select("_block", "place", "pair").join(counts, "pair").select(F.col("_block").alias("_of"), "place", "count", (F.col("count") == F.col("most")).alias("best"))
    texts = found.where("pairs IS NULL").select(*NAMES[:-3])

    def total(rows: pa.Table, told: pa.Table) -> pa.Table:
        order = np.argsort(told.column("place").to_numpy())
        count = told.column("count").to_numpy()[order]
        best = told.column("best").to_numpy()[order].astype(np.int64)
        sums = []
        for raw in rows.column("links").to_pylist():
            at = of_planes(raw)
            sums.append((int(best[at].sum()), int(count[at].sum())))
        out = {c: rows.column(c) for c in NAMES[1:6]} | {"n_best": pa.array([s[0] for s in sums], pa.int64()), "count_sum": pa.array([s[1] for s in sums], pa.int64()), "groups_sha256": rows.column("groups_sha256")}
        return pa.table(out)

    return texts.groupBy("_block").cogroup(answers.groupBy("_of")).applyInArrow(total, OUT)
