"""SimHash near-duplicates (operator 7): fingerprints of word shingles, a trie self-join, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import Words, settled, slices, utf8

SHINGLE, BITS, ERRORS, SEED = 3, 64, 2, 42
#: Fingerprints that one route may bring together before it is split.
MOST_ON_ROUTE = 100_000
#: Node pairs that the traversal holds at a time.
FRONTIER = 200_000
#: Splits of a route at most: its open bits are then so few that no segment of three is left.
DEEPEST = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints_of(buf: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprints of some texts: bit b is set if more than half of the shingles' hashes have it."""
    words = Words(_LOWER[buf], offsets)
    text, at = words.joined()
    raw = text.tobytes()
    out = np.zeros(len(offsets) - 1, np.uint64)
    one = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    places = at.tolist()
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        if a == b:
            continue
        k = min(shingle, b - a)
        n = b - a - k + 1
        hashes = np.fromiter((digest(raw[s : e - 1], SEED) for s, e in zip(places[a : a + n], places[a + k : b + 1], strict=True)), "<u8", n)
        votes = np.zeros(BITS, np.int64)
        for j in range(0, n, 4096):  # a long text's bits, a part at a time
            votes += np.unpackbits(hashes[j : j + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = one[2 * votes > n].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (as a signed 64-bit number) of each row of docs."""

    def part_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints_of(part, at, shingle) for _, _, part, at in slices(*utf8(batch.column("text")))]
            values = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fingerprint": pa.array(values.view(np.int64))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(part_of, "doc_id long, fingerprint long")


def trie_links(values: np.ndarray, groups: np.ndarray, errors: int = ERRORS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in `values` (distinct in a group, sorted by group and value) of one group and at most `errors` differing bits.

    The groups are tries of bits. Pairs of nodes go down together from each root's pair with itself,
    with the bits that differ so far; a pair over the budget is dropped with all below it. A node is a
    range of the sorted values. Depth first over bounded parts of the frontier, so memory is bounded.
    """
    begins = np.flatnonzero(np.diff(np.concatenate([[-1], groups])) != 0) if len(groups) else np.zeros(0, np.int64)
    ends = np.append(begins[1:], len(values))
    big = ends - begins > 1
    stack = [(BITS - 1, begins[big], ends[big], begins[big], ends[big], np.zeros(int(big.sum()), np.int64))]
    while stack:
        bit, a0, a1, b0, b1, wrong = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(bit, *(x[half:] for x in (a0, a1, b0, b1, wrong))), (bit, *(x[:half] for x in (a0, a1, b0, b1, wrong)))]
            continue
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            x, y = a0[single], b0[single]
            near = (x != y) & (np.bitwise_count(values[x] ^ values[y]) <= errors)
            if near.any():
                yield x[near], y[near]
            a0, a1, b0, b1, wrong = (x[~single] for x in (a0, a1, b0, b1, wrong))
        if not len(a0) or bit < 0:
            continue
        cut_a, cut_b = _cuts(values, a0, a1, bit), _cuts(values, b0, b1, bit)
        parts = [(a0, cut_a, b0, cut_b, wrong), (cut_a, a1, cut_b, b1, wrong), (a0, cut_a, cut_b, b1, wrong + 1)]
        other = ~((a0 == b0) & (a1 == b1))  # a node with itself has one mixed pair, two nodes have two
        parts.append((cut_a[other], a1[other], b0[other], cut_b[other], wrong[other] + 1))
        nxt = [np.concatenate(x) for x in zip(*parts, strict=True)]
        alive = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= errors)
        alive &= ~((nxt[0] == nxt[2]) & (nxt[1] == nxt[3]) & (nxt[1] - nxt[0] == 1))
        if alive.any():
            stack.append((bit - 1, *(x[alive] for x in nxt)))


def _cuts(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """For each range, in which all higher bits agree, the first place with the bit set: a binary search of all at once."""
    low, high = low.copy(), high.copy()
    mask = np.uint64(1) << np.uint64(bit)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) // 2
        is_set = (values[mid] & mask) != 0
        high[open_[is_set]] = mid[is_set]
        low[open_[~is_set]] = mid[~is_set] + 1


def joined_roots(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n positions the smallest that the links lead to."""
    root = np.arange(n)
    for x, y in links:
        while True:
            a, b = root[x], root[y]
            apart = a != b
            if not apart.any():
                break
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def _bits_left(path: int) -> tuple[list[int], list[list[int]]]:
    """The bits that a route of this path leaves open, and its next segments of them. A path has a digit 1, 2 or 3 for each split."""
    left, segment = list(range(BITS)), []
    digits = []
    while path:
        digits.append(path % 4)
        path //= 4
    for d in reversed(digits):
        segment = _thirds(left)[d - 1]
        left = [b for b in left if b not in segment]
    return left, _thirds(left)


def _thirds(bits: list[int]) -> list[list[int]]:
    n = len(bits)
    cuts = [i * n // (ERRORS + 1) for i in range(ERRORS + 2)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def routed(rows: DataFrame) -> DataFrame:
    """Routes for rows (fingerprint, path, key): two fingerprints within the budget agree on one of three segments of the open bits."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("fingerprint").to_numpy().view(np.uint64)
            path, key = batch.column("path").to_numpy(), batch.column("key").to_numpy().view(np.uint64)
            for p in np.unique(path):
                here = path == p
                for d, segment in enumerate(_bits_left(int(p))[1], 1):
                    value = key[here]
                    for b in segment:
                        value = (value << np.uint64(1)) | ((f[here] >> np.uint64(b)) & np.uint64(1))
                    yield pa.RecordBatch.from_pydict({"fingerprint": pa.array(f[here].view(np.int64)), "path": pa.array(np.full(int(here.sum()), p * 4 + d), pa.int64()), "key": pa.array(value.view(np.int64))})

    return rows.mapInArrow(expand, "fingerprint long, path long, key long")


def links(distinct: DataFrame, most: int = MOST_ON_ROUTE) -> DataFrame:
    """Links between distinct fingerprints (a column), enough to connect all that differ in at most ERRORS bits: low, high.

    A route with more than `most` fingerprints is split by a segment of its open bits, again and again. A split
    leaves two thirds of them open, so after five no route can hold 100,000 different fingerprints; with a
    smaller `most` splitting ends where a route has too few open bits to be split.
    """
    rows = routed(distinct.select("fingerprint", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("key")))
    for _ in range(DEEPEST):
        hot = settled(rows.groupBy("path", "key").count().where(F.col("count") > most).select("path", "key"), "hot-routes")
        if hot.isEmpty():
            break
        rows = rows.join(hot, ["path", "key"], "left_anti").select("fingerprint", "path", "key").unionByName(routed(rows.join(hot, ["path", "key"], "left_semi").select("fingerprint", "path", "key")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Routes one after another, whole ones at a time: a task holds a route and a batch, not its partition."""
        held: list[np.ndarray] = []

        def close(f: np.ndarray, path: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.concatenate([[0], (np.diff(path) != 0) | (np.diff(key) != 0)]))
            order = np.lexsort((f, group))
            f, group = f[order], group[order]
            root = joined_roots(len(f), trie_links(f, group))
            far = np.flatnonzero(root != np.arange(len(f)))
            a, b = f[root[far]].view(np.int64), f[far].view(np.int64)
            return pa.RecordBatch.from_pydict({"low": pa.array(np.minimum(a, b)), "high": pa.array(np.maximum(a, b))})

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(c).to_numpy() for c in ("fingerprint", "path", "key")]))
            last = held[-1][1:]
            cut = np.flatnonzero((last[:, 1:] != last[:, :-1]).any(axis=0))
            start = int(cut[-1]) + 1 if len(cut) else 0  # of the last route, which may go on
            before = held[-2][1:, -1] if len(held) > 1 else None
            if not start and (before is None or (before == last[:, 0]).all()):
                continue
            whole = np.concatenate([*held[:-1], held[-1][:, :start]], axis=1)
            held[:] = [held[-1][:, start:]]
            if whole.shape[1]:
                yield close(whole[0].view(np.uint64), whole[1], whole[2])
        if held:
            whole = np.concatenate(held, axis=1)
            yield close(np.ascontiguousarray(whole[0]).view(np.uint64), whole[1], whole[2])

    return rows.repartition("path", "key").sortWithinPartitions("path", "key").mapInArrow(search, "low long, high long").distinct()


def _mark(edges: DataFrame, name: str) -> DataFrame:
    """One row that two sets of edges share only if they are the same: their number, and the sum and xor of hashes."""
    hashed = F.xxhash64("low", "high")
    return edges.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.bit_xor(hashed).alias("x"), F.sum(hashed.cast("decimal(38,0)")).alias("s"))


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node that the edges (low, high; low < high) lead to) of all nodes of the edges.

    Large stars and small stars in turn, each round written to the shared folder, until nothing changes.
    """
    edges = settled(edges, "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("high").alias("low"), F.col("low").alias("high")))  # low: a node, high: a neighbour
        least = both.groupBy("low").agg(F.least(F.min("high"), F.col("low")).alias("least"))
        large = both.where("high > low").join(least, "low").select(F.col("least").alias("low"), "high").where("low < high").distinct()
        large = settled(large, "large-star")
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(least, "high").select(F.col("least"), "low", "high")
        small = small.select(F.col("least").alias("low"), "high").unionByName(small.where("least < low").select(F.col("least").alias("low"), F.col("low").alias("high"))).distinct()
        small = settled(small, "small-star")
        marks = _mark(edges, "edges").unionByName(_mark(large, "large")).unionByName(_mark(small, "small")).collect()
        edges = small
        if len({(m.n, m.x, m.s) for m in marks}) == 1:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of docs (doc_id, text).

    Texts are taken with A-Z in lower case, as words `[^\\x20\\x09-\\x0D]+`; shingles are `shingle`
    consecutive words joined by a space (a shorter text: all its words), hashed by XXH64 with seed 42.
    Fingerprints link at two or fewer differing bits; component_id is the smallest doc_id that links
    lead to. Null and empty texts have fingerprint zero and link like others. Null doc_ids don't count as smallest
    (a component of null ids only has a null component_id); repeated rows appear each; an empty table stays empty; other columns are left
    out. Exact copies meet once, as one fingerprint, before anything is compared.
    """
    prints = settled(fingerprints(docs, shingle), "fingerprints")
    distinct = settled(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    nodes = components(links(distinct.select("fingerprint")))
    rooted = distinct.join(nodes, distinct["fingerprint"] == nodes["node"], "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = settled(rooted.join(first, "root").select(F.col("fingerprint"), "component_id"), "components")
    return prints.join(named, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
