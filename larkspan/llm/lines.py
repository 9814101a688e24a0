"""Removal of lines that other documents hold already (operator 8): two Bloom filters, then exact confirmation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.blocks import asked, blocked, bucket_bits, marks_of
from larkspan.llm.common import total_bytes, with_columns

#: Code points of the shortest key that counts.
LEAST = 10
#: Bits for each hash in a Bloom filter, and places that a hash sets.
BLOOM_BITS, BLOOM_PLACES = 12, 4
LAST = np.iinfo(np.int64).max
#: A key that so many blocks hold is spread over SALTS groups when its first document is told to them.
HOT, SALTS = 1024, 64
ADDED = ["n_lines", "n_dropped"]


def _keys(text: str | None, least: int) -> tuple[list[bytes], list[bytes | None]]:
    """A text's lines, and the key of each (None: too short to count)."""
    lines = (text or "").encode().split(b"\n")
    keys = [x.strip(b" \t\n\x0b\x0c\r").lower() for x in lines]  # of bytes: A-Z alone
    return lines, [k if len(k) >= least and (len(k) >= 4 * least or len(k.decode()) >= least) else None for k in keys]


def _judge(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    """A bucket's two Bloom filters, once-seen and twice-seen; marks what the second may hold, and which of that at least HOT blocks have."""
    size = max(64, BLOOM_BITS * sum(len(h) for _, h, _ in rows))
    once, twice = np.zeros(size, bool), np.zeros(size, bool)

    def places(h: np.ndarray) -> np.ndarray:
        step = (h * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        return np.stack([(h + np.uint64(k) * step) % np.uint64(size) for k in range(BLOOM_PLACES)]).astype(np.int64)

    for _, h, again in rows:
        at = places(h)
        twice[at[:, once[at].all(axis=0) | again]] = True
        once[at] = True
    hashes, blocks = np.unique(np.concatenate([h for _, h, _ in rows]), return_counts=True) if len(rows) >= HOT else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    hot = hashes[blocks >= HOT]
    return [(block, np.stack([twice[places(h)].all(axis=0), np.isin(h, hot)])) for block, h, _ in rows]


def deduped_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs without the lines whose key an earlier document holds.

    Texts split at \\n (null or empty: one empty line). A line's key is the line without
    `[\\x20\\x09-\\x0D]` at both ends, A-Z in lower case. A key of at least `least` code points in at
    least two documents loses its lines everywhere but in the smallest doc_id that holds it, where all
    of them stay. Each bucket of hashes fills a once-seen and a twice-seen Bloom filter; only keys that
    the second may hold move as text, one row for each block of documents, and are confirmed exactly. Rows of an
    id may lie in several blocks, and a key that many blocks hold is salted, so neither an id nor a line fills a task.

    Returns the columns of docs, text being what is left joined by \\n ('' if nothing is), and n_lines (before) and
    n_dropped; columns of docs with these names give way. Rows of one doc_id are one document; null
    ids are one document after all others; an empty table stays empty.
    """
    rows = with_columns(docs, ADDED)
    names = rows.columns
    size = total_bytes(rows)[1]
    bits = bucket_bits(size // 40)
    blocks = blocked(rows.withColumn("text", F.col("text").cast("string")), "text", size).select("_block", *[f"`{c}`" for c in names])

    def block_keys(table: pa.Table) -> dict[bytes, tuple[int, int]]:
        """Each key's smallest and largest doc_id in a block."""
        found: dict[bytes, tuple[int, int]] = {}
        for doc, text in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True):
            doc = LAST if doc is None else doc
            for k in set(_keys(text, least)[1]):
                if k is not None:
                    a, b = found.get(k, (doc, doc))
                    found[k] = (min(a, doc), max(b, doc))
        return found

    def hashed(found: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in found), np.uint64, len(found))
        return h, np.fromiter((a < b for a, b in found.values()), bool, len(found))

    def hashes_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        h, several = hashed(block_keys(table))
        hashes, place = np.unique(h, return_inverse=True)
        again = np.bincount(place, minlength=len(hashes)) > 1
        again[place[several]] = True
        return hashes, again

    def suspects(left: pa.Table, right: pa.Table) -> pa.Table:
        found = block_keys(left)
        h, _ = hashed(found)
        hashes, place = np.unique(h, return_inverse=True)
        marked, hot = marks_of(right, hashes, bits, 2)[:, place] if len(h) else np.zeros((2, 0), bool)
        block = left.column("_block")[0].as_py() if left.num_rows else None
        salt = 0 if block is None else block % SALTS + 1
        rows = [(k, a, b, salt if spread else 0) for (k, (a, b)), m, spread in zip(found.items(), marked.tolist(), hot.tolist(), strict=True) if m]
        return pa.table({"_block": pa.array([block] * len(rows), pa.int64()), "_key": pa.array([r[0] for r in rows], pa.binary()), "_low": pa.array([r[1] for r in rows], pa.int64()), "_high": pa.array([r[2] for r in rows], pa.int64()), "_salt": pa.array([r[3] for r in rows], pa.int32())})

    def drop(left: pa.Table, right: pa.Table) -> pa.Table:
        first = dict(zip(right.column("_key").to_pylist(), right.column("_first").to_pylist(), strict=True))
        texts, n_lines, n_dropped = [], [], []
        for doc, text in zip(left.column("doc_id").to_pylist(), left.column("text").to_pylist(), strict=True):
            doc = LAST if doc is None else doc
            lines, keys = _keys(text, least)
            kept = [x for x, k in zip(lines, keys, strict=True) if k is None or first.get(k, doc) == doc]
            texts.append(b"\n".join(kept).decode())
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        out = {c: left.column(c) for c in names} | {"text": pa.array(texts, pa.string())}
        return pa.table(out | {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())})

    answers = asked(blocks, hashes_of, _judge, bits)
    keys = blocks.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(suspects, "_block long, _key binary, _low long, _high long, _salt int")
    parts = keys.groupBy("_key", "_salt").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.collect_list("_block").alias("_blocks"))
    # A key has one row of parts, or one for each salt. The blocks are counted too, so that both uses of parts read one shuffle.
    told = parts.groupBy("_key").agg(F.min("_low").alias("_first"), F.max("_high").alias("_last"), F.sum(F.size("_blocks")).alias("_n"), F.collect_list("_salt").alias("_salts"))
    told = told.where("_first < _last AND _n > 0").select("_key", "_first", F.explode("_salts").alias("_salt"))
    winners = parts.join(told, ["_key", "_salt"]).select(F.explode("_blocks").alias("_block"), "_key", "_first")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString() if f.name != 'text' else 'string'}, " for f in rows.schema) + "n_lines long, n_dropped long"
    return blocks.groupBy("_block").cogroup(winners.groupBy("_block")).applyInArrow(drop, schema)
