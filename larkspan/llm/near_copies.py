"""Near copies for the pipeline: sets of word shingles of Jaccard similarity 0.8 or more, found by SimHash and by MinHash bands, confirmed exactly, connected components.

SimHash brings together what operator 7's trie self-join links: fingerprints of the shingles within two bits, and what such links chain.
A pair of similarity 0.8 differs in ten of 64 bits on average, so no bit budget that an index can serve reaches all pairs; bands
of MinHash values bring the rest together. What shares a SimHash component or a band is compared as whole sets, so no link is a guess; a pair of
similarity 0.8 misses all BANDS bands with probability (1 - 0.8**ROWS)**BANDS, 5 in 100,000, and one of higher similarity more seldom.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import Words, mixed, rolling, settled, slices, utf8
from larkspan.llm.simhash import _LOWER, components, fingerprints_of, links as linked_prints

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
#: Texts of a band that one task compares at a time; what a larger band has beyond is compared in blocks of as many.
CHUNK = 512

_RANDOM = np.random.default_rng(20240602)
_FLIP = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def sets_of(buf: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[list[bytes], list[np.ndarray]]:
    """A 128-bit name of each text's words, and the sorted hashes of its distinct shingles (a shorter text: all its words; none without words)."""
    words = Words(_LOWER[buf], offsets)
    hashes = words.hashes()
    whole = rolling(hashes, shingle)
    names: list[bytes] = []
    sets: list[np.ndarray] = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        raw = hashes[a:b].tobytes()
        names.append(xxhash.xxh3_128_digest(raw))
        sets.append(np.unique(whole[a : b - shingle + 1]) if b - a >= shingle else np.array([xxhash.xxh3_64_intdigest(raw)] if b > a else [], np.uint64))
    return names, sets


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """The BANDS keys of each set; the sets aren't empty."""
    values = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.zeros((len(sets), BANDS), np.uint64)
    for k, (flip, times) in enumerate(zip(_FLIP, _TIMES, strict=True)):
        out[:, k // ROWS] = mixed(out[:, k // ROWS] + np.minimum.reduceat((values ^ flip) * times, starts) + np.uint64(k))
    return out


def set_links(nodes: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> Iterator[tuple[int, int]]:
    """Links (smaller node first) that connect all of some sets that chains of pairs of the similarity connect: breadth first."""
    lengths = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(lengths) - lengths
    marked = np.zeros(int(ids.max()) + 1, np.int64)
    left = np.ones(len(sets), bool)
    queue: list[int] = []
    while left.any():
        if not queue:
            queue.append(int(np.argmax(left)))
            left[queue[0]] = False
        x = queue.pop()
        own = ids[starts[x] : starts[x] + lengths[x]]
        marked[own] = 1
        shared = np.add.reduceat(marked[ids], starts)
        marked[own] = 0
        found = np.flatnonzero(left & (shared * (1 + similarity) >= similarity * (lengths + lengths[x]) - 1e-9))
        left[found] = False
        for y in found.tolist():
            queue.append(y)
            yield min(int(nodes[x]), int(nodes[y])), max(int(nodes[x]), int(nodes[y]))


def _compared(rows: DataFrame, similarity: float) -> DataFrame:
    """Links between the sets of each group of rows (key, part, node, shingles)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: list[int] = []
        high: list[int] = []
        group, held = None, {}

        def close() -> None:
            if len(held) > 1:
                for a, b in set_links(np.fromiter(held, np.int64, len(held)), list(held.values()), similarity):
                    low.append(a)
                    high.append(b)
            held.clear()

        for batch in batches:
            column = batch.column("shingles")
            values, ends = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum([0, *column.value_lengths().to_pylist()])
            for i, (key, part, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "part", "node")), strict=True)):
                if (key, part) != group:
                    close()
                    group = (key, part)
                held[node] = values[ends[i] : ends[i + 1]].copy()
            yield pa.RecordBatch.from_pydict({"low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())})
            low.clear()
            high.clear()
        close()
        yield pa.RecordBatch.from_pydict({"low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())})

    return rows.select("key", "part", "node", "shingles").repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(search, "low long, high long").distinct()


def simhash_components(texts: DataFrame) -> DataFrame:
    """node and key of texts (node, fingerprint): texts share a key if SimHash links lead from one's fingerprint to the other's."""
    distinct = settled(texts.select("fingerprint").distinct(), "distinct-fingerprints")
    roots = components(linked_prints(distinct)).select(F.col("node").alias("fingerprint"), "root")
    return settled(texts.join(roots, "fingerprint", "left").select("node", F.coalesce("root", "fingerprint").alias("key")), "simhash-components")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text_hash (Spark's xxhash64 of the text), component_id and first of each row of docs (doc_id, text).

    Texts are taken with A-Z in lower case, as words `[^\\x20\\x09-\\x0D]+`; they link if the sets of their
    shingles (`shingle` consecutive words; a shorter text: all its words) have at least this Jaccard
    similarity. component_id is the smallest doc_id that links lead to (null: only null ids). `first` marks the
    component's one document: the smallest doc_id (null after all others), of rows with that id the smallest
    text_hash; repeated rows are marked alike. Null and empty texts are copies of each other; an empty table stays empty.

    Exact copies meet once. SimHash components are bands beside those of MinHash. Bands with the same texts are compared once. A band of over `chunk` texts
    is first compared in parts; then, where components still differ, what isn't in its largest
    component is compared with all of it, in blocks.
    """
    text_hash = F.xxhash64(F.col("text").cast("string"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash.alias("text_hash"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part, at in slices(*utf8(batch.column("text"))):
                names, sets = sets_of(part, at, shingle)
                some = [k for k, s in enumerate(sets) if len(s)]
                found: list[list[int]] = [[] for _ in sets]
                if some:
                    for k, row in zip(some, bands_of([sets[k] for k in some]).view(np.int64).tolist(), strict=True):
                        found[k] = row
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(i, j - i), "text_hash": batch.column("text_hash").slice(i, j - i), "words": pa.array(names, pa.binary()), "fingerprint": pa.array(fingerprints_of(part, at, shingle).view(np.int64)), "keys": pa.array(found, pa.list_(pa.int64()))})

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part, at in slices(*utf8(batch.column("text"))):
                yield pa.RecordBatch.from_pydict({"words": pa.array(sets_of(part, at, shingle)[0], pa.binary()), "text": batch.column("text").slice(i, j - i)})

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part, at in slices(*utf8(batch.column("text"))):
                sets = sets_of(part, at, shingle)[1]
                ends = np.cumsum([0] + [len(s) for s in sets])
                yield pa.RecordBatch.from_pydict({"node": batch.column("node").slice(i, j - i), "shingles": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))})

    prints = settled(docs.mapInArrow(keys, "doc_id long, text_hash long, words binary, fingerprint long, keys array<long>"), "shingle-keys")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    texts = prints.groupBy("words").agg(F.first("fingerprint").alias("fingerprint"), F.first("keys").alias("keys"), F.min(order).alias("first"))
    texts = settled(texts.select(F.monotonically_increasing_id().alias("node"), "*"), "distinct-texts")  # numbered once, as written
    worded = texts.where(F.size("keys") > 0)
    rows = worded.select("node", F.explode("keys").alias("key")).unionByName(simhash_components(worded.select("node", "fingerprint")))
    bands = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("a"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("b")).where("n > 1")
    bands = settled(bands.groupBy("n", "a", "b").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / chunk).cast("int").alias("ways")), "bands")
    members = settled(rows.join(bands, "key").select("node", "key", "ways", F.pmod(F.xxhash64("node", "key"), F.col("ways")).cast("int").alias("part")), "members")
    wanted = texts.select("node", "words").join(members.select("node").distinct(), "node", "left_semi")
    sets = docs.select("text").mapInArrow(named, "words binary, text string").join(wanted, "words")
    sets = settled(sets.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(shingles, "node long, shingles array<long>"), "shingle-sets")
    links = settled(_compared(members.join(sets, "node"), similarity), "links")
    nodes = components(links)
    large = members.where("ways > 1")
    if not large.isEmpty():
        rooted = large.join(nodes.select("node", "root"), "node", "left").select("node", "key", "ways", "part", F.coalesce("root", "node").alias("root"))
        most = rooted.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.sum("count").alias("n"), F.max("count").alias("in_most"))
        most = most.where("n > in_most").select("key", "most", F.ceil((F.col("n") - F.col("in_most")) / chunk).cast("int").alias("cuts"))
        rooted = settled(rooted.join(most, "key"), "large-bands")
        cut = F.pmod(F.xxhash64("key", "node"), F.col("cuts")).cast("int")
        home = rooted.select("node", "key", F.col("part").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("j"))
        others = rooted.where("root <> most").select("node", "key", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("i"), cut.alias("j"))
        blocks = home.unionByName(others).distinct().select("node", "key", (F.col("i").cast("long") * (1 << 31) + F.col("j")).alias("part"))
        nodes = components(links.unionByName(_compared(blocks.join(sets, "node"), similarity)).distinct())
    rooted = texts.select("node", "words", "first").join(nodes, "node", "left").select("words", "first", F.coalesce("root", "node").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first").alias("_first"))
    named_ = settled(rooted.join(first, "root").select("words", "_first"), "copies")
    out = prints.select("doc_id", "text_hash", "words").join(named_, "words")
    return out.select("doc_id", "text_hash", F.col("_first.doc_id").alias("component_id"), (F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash").eqNullSafe(F.col("_first"))).alias("first"))


def without_copies(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others) with one document of each component of near copies: its `first`, and of repeated rows of that one.

    Rows of one doc_id are told apart by their texts, and so are rows without an id.
    """
    marked = settled(near_copies(docs.select("doc_id", "text")), "near-copies")
    gone = marked.where("NOT first").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    again = settled(marked.where("first").groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")), "repeated-rows")
    rows = docs.withColumn("_own", F.xxhash64(F.col("text").cast("string")))
    on = lambda other: rows["doc_id"].eqNullSafe(other["_doc"]) & (rows["_own"] == other["_hash"])
    if again.isEmpty():
        return rows.join(gone, on(gone), "left_anti").drop("_own")
    gone = gone.unionByName(again)
    once = rows.join(again, on(again), "left_semi").groupBy("doc_id", "_own").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row")).select("_row.*")
    return rows.join(gone, on(gone), "left_anti").drop("_own").unionByName(once)
