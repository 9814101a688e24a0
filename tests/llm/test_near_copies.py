import random

import corpus_pipeline
import numpy as np
import pytest

from larkspan.llm import near_copies
from tests.llm import brute


def shingles(text, k=5):
    w = brute.WORD.findall((text or "").translate(brute.LOWERED))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def by_all_pairs(rows, least=0.8):
    """The smallest id that each id's links lead to, by comparing all pairs."""
    sets, root = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            a, b = sets[x], sets[y]
            if x < y and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                lo, hi = sorted((top(x), top(y)))
                root[hi] = lo
    return {d: top(d) for d in ids}


@pytest.fixture(scope="module")
def planted():
    """Texts with copies of 0 to 12 changed words, chains of copies of copies, exact copies, short and empty texts."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 250))]
        chain = list(base)
        texts.append(" ".join(base))
        for n in range(13):
            copy = list(base)
            for at in rng.sample(range(len(base)), n):
                copy[at] = word()
            chain[rng.randrange(len(chain))] = word()
            texts += [" ".join(copy), "\n".join(chain).upper()]
    texts += ["a b c d", "A  b c D", "a b c e", "", None, " \n", "x y z u v", "x y z u v w"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("chunk", [512, 4])
def test_near_copies_equal_all_pairs(spark, planted, chunk):
    docs = spark.createDataFrame(planted, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, chunk=chunk).collect()}
    assert got == by_all_pairs(planted)
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_the_stage_drops_near_copies(spark, planted):
    docs = spark.createDataFrame([*planted, (None, planted[0][1])], "doc_id long, text string")
    left = [r.doc_id for r in corpus_pipeline.by_near_duplicates(spark, docs, "").collect()]
    assert sorted(left) == sorted(set(by_all_pairs(planted).values()))


def test_rows_of_one_id_are_told_apart(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(3, text("a"), "x"), (5, text("a"), "x"), (5, text("b"), "y"), (5, text("b"), "z"), (None, text("c"), "p"), (None, text("c"), "q"), (None, text("d"), None), (8, text("d"), None), (9, None, None), (10, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first string")
    left = corpus_pipeline.by_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:1]) for r in left) == [(0, "c"), (3, "a"), (5, "b"), (8, "d"), (9, "")]


def test_simhash_brings_texts_together(spark, monkeypatch):
    """Without any band in common, copies within two bits are found; equal fingerprints of different texts don't make them copies."""
    monkeypatch.setattr(near_copies, "bands_of", lambda sets: np.array([[s.sum(dtype=np.uint64) + np.uint64(k) for k in range(3)] for s in sets]))
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    copies = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in (3, 700, 1500)]
    drill = "a b c d e " * 200
    rows = list(enumerate([" ".join(base), *copies, drill + " ".join(base[:60]), drill + " ".join(base[100:160]), "", None]))
    prints = [brute.fingerprint(t, 5) for _, t in rows]
    assert prints[4] == prints[5] and all((prints[0] ^ p).bit_count() <= 2 for p in prints[1:4]) and len(set(prints[:4])) > 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == by_all_pairs(rows) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 6, 7: 6}
