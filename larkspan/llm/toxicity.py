"""Toxicity scores (operator 5): averaged subword embeddings under a linear softmax, trained jointly in numpy.

A text is the mean of the vectors of its subwords: each word and its n-grams of 3 to 5 bytes of UTF-8, with
the spaces around it; rare subwords weigh more (inverse document frequency). So a misspelling shares
most of its vectors with the word. Vectors and softmax are learned together by gradient descent, in one task.
Only the learning sees labels: at most SAMPLE rows of them and SAMPLE_BYTES of their texts' counts, whatever the size of the tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.common import Words, settled, slices, utf8, with_columns

#: Labelled doc_ids that the model learns from at most, those with the lowest hashes, and bytes of their counts of subwords (8 a subword of a text).
SAMPLE, SAMPLE_BYTES = 6000, 128 << 20
#: Buckets of subwords (a power of two), and the length of their vectors.
BUCKET_BITS, WIDTH = 16, 8
GRAMS = (3, 4, 5)
EPOCHS, BATCH, RATE, SCALE = 12, 32, 0.5, 100.0
THRESHOLD = 0.3
ADDED = ["held_out", "score", "predicted"]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def subwords(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all subwords of some texts (A-Z in lower case), and the text of each."""
    words = Words(_LOWER[buf], offsets)
    if not len(words.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = np.arange(len(offsets) - 1)
    text, at = words.joined()
    text = np.concatenate([np.array([0x20], np.uint8), text])
    owner_of_word = np.repeat(rows, np.diff(words.first))
    owner = np.repeat(owner_of_word, np.diff(at))  # of the n-gram that starts with the byte before
    spaces = np.concatenate([[0], np.cumsum(text == 0x20)])
    shift = np.uint32(32 - BUCKET_BITS)
    buckets, owners = [], []
    value = text.astype(np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if n == 1:
            h = value.copy()
            continue
        h = h[: len(text) - n + 1] * np.uint32(0x01000193) + value[n - 1 :]
        if n in GRAMS:
            inner = spaces[n - 1 : len(text)][: len(h)] - spaces[1 : len(h) + 1]
            good = np.flatnonzero(inner == 0)
            good = good[good < len(owner)]
            mix = (h[good] ^ (h[good] >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            buckets.append(((mix ^ (mix >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> shift)
            owners.append(owner[good])
    buckets.append((words.hashes() >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32))
    owners.append(owner_of_word)
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


class Batch:
    """Some texts for training: their buckets, and of each subword its bucket's place among these, its text and its share in the text's mean."""

    def __init__(self, features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rarity: np.ndarray) -> None:
        self.labels = labels
        self.buckets, place = np.unique(np.concatenate([ids for ids, _ in features]), return_inverse=True)
        self.place = place.astype(np.int32)  # all batches are held at once
        self.row = np.repeat(np.arange(len(features), dtype=np.int32), [len(ids) for ids, _ in features])
        self.share = np.concatenate([n / max(1, n.sum()) for _, n in features]) * rarity[self.buckets][place]


def step(vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray, batch: Batch, rate: float) -> None:
    """One step down the gradient of a batch's mean log loss, in place; it reads and changes the vectors of the batch's buckets alone."""
    own, n = vectors[batch.buckets], len(batch.labels)
    # Of two classes' logits the softmax reads the difference alone, and their gradients are each other's negatives.
    apart = np.bincount(batch.row, batch.share * (own @ (weights[:, 1] - weights[:, 0]))[batch.place], n) + bias[1] - bias[0]
    wrong = (1 / (1 + np.exp(-np.clip(apart, -700, 700))) - batch.labels) / n
    by_bucket = np.bincount(batch.place, batch.share * wrong[batch.row], len(own))
    by_bucket = np.stack([-by_bucket, by_bucket], axis=1)
    slope = own.T @ by_bucket
    vectors[batch.buckets] = own - rate * (by_bucket @ weights.T)
    weights -= 0.1 * rate * slope
    bias -= 0.1 * rate * np.array([-wrong.sum(), wrong.sum()])


def trained(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """From (buckets, counts) and label of each text: by bucket, what it adds to the log odds of label 1; and the log odds without any.

    The model is softmax(SCALE * mean(weight * vector) @ weights + bias); as it's linear behind the mean, a
    bucket's weighted vector times the difference of the softmax weights is all that scoring needs.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.01, (1 << BUCKET_BITS, WIDTH))
    weights = rng.normal(0, 0.5, (WIDTH, 2))
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3) if len(labels) else 1e-3
    bias = np.log(np.array([1 - share, share]))
    texts_with = np.zeros(len(vectors))
    for ids, _ in features:
        texts_with[ids] += 1
    rarity = SCALE * (np.log((len(features) + 1) / (texts_with + 1)) + 0.1)
    order = rng.permutation(len(labels))
    batches = [Batch([features[i] for i in some], labels[some], rarity) for a in range(0, len(order), BATCH) if len(some := order[a : a + BATCH])]
    for epoch in range(EPOCHS if batches else 0):
        for k in rng.permutation(len(batches)):
            step(vectors, weights, bias, batches[k], RATE * (1 - epoch / EPOCHS))
    return rarity * ((vectors @ weights) @ np.array([-1.0, 1.0])), float(bias[1] - bias[0])


def held_out() -> F.Column:
    """True for the fold that learning never sees: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    """The model of docs (doc_id, text) and labels (doc_id, toxic).

    A doc_id with several labels counts as toxic if one of them says so; one with several texts is
    learned by one of them. So the sample has a row for each doc_id, `sample` rows at most, and in the order
    of their hashes no more than fit into `sample_bytes`.
    """
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", F.xxhash64("doc_id").alias("place")).orderBy("place", "doc_id").limit(sample)  # `sample` rows of three numbers: may be broadcast

    def count_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column("text"))
            found = []
            for i, j, part, at in slices(buf, offsets):
                ids, owner = subwords(part, at)
                order = np.argsort(owner, kind="stable")
                ids, edges = ids[order], np.searchsorted(owner[order], np.arange(j - i + 1))
                for k in range(j - i):
                    b, n = np.unique(ids[edges[k] : edges[k + 1]], return_counts=True)
                    found.append((b.astype("<u4").tobytes(), n.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "toxic", "place")} | {"ids": pa.array([f[0] for f in found], pa.binary()), "counts": pa.array([f[1] for f in found], pa.binary())})

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        features = [(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(n.as_buffer(), "<u4")) for b in rows for x, n in zip(b.column("ids"), b.column("counts"), strict=True)]
        known = np.concatenate([b.column("toxic").to_numpy() for b in rows]) if rows else np.zeros(0)
        weights, bias = trained(features, known.astype(np.int64))
        yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.astype("<f8").tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", "place").mapInArrow(count_part, "doc_id long, toxic int, place long, ids binary, counts binary")
    one = rows.groupBy("doc_id", "toxic", "place").agg(F.min(F.struct("ids", "counts")).alias("f")).select("doc_id", "toxic", "place", "f.*")
    one = settled(one, "toxicity-sample")
    before = Window.orderBy("place", "doc_id")  # over `sample` rows at most
    fit = one.select("doc_id", F.sum(F.octet_length("ids") + F.octet_length("counts")).over(before).alias("held")).where(F.col("held") <= sample_bytes).select("doc_id")
    ordered = one.join(F.broadcast(fit), "doc_id").repartition(1).sortWithinPartitions("place", "doc_id")
    row = ordered.mapInArrow(train, "weights binary, bias double").first()
    return (np.frombuffer(row.weights, "<f8"), row.bias) if row else trained([], np.zeros(0, np.int64))


def scored(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted."""
    weights, bias = model[0].astype(np.float32), model[1]
    names = docs.columns

    def score_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = []
            for i, j, part, at in slices(*utf8(batch.column("text"))):
                ids, owner = subwords(part, at)
                odds.append(np.bincount(owner, weights[ids], j - i) / np.maximum(np.bincount(owner, minlength=j - i), 1) + bias)
            score = 1 / (1 + np.exp(-np.clip(np.concatenate(odds) if odds else np.zeros(0), -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema) + "score double, predicted int"
    return docs.mapInArrow(score_part, schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text) with held_out, score (0 to 1, higher: likelier toxic) and predicted (1 from THRESHOLD on).

    Every whole text is scored; null and empty texts get the score of the learned bias alone. Labels
    of null doc_ids, null labels and the held-out fold don't count; without labels all scores are low and
    alike. A null doc_id isn't held out. Repeated rows are scored each, and learned once a doc_id; columns of docs with the names
    of the added ones give way; an empty table stays empty.
    """
    model = learned(docs, labels, sample)
    docs = with_columns(docs, ADDED).withColumn("text", F.col("text").cast("string"))
    return scored(docs, model).withColumn("held_out", held_out())
