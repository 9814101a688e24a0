import itertools
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from larkspan.llm import best_fit, queries
from larkspan.llm.common import table
from larkspan.llm.tokens import vocabulary


def plain(sizes, length):
    """Sequences by plain loops over items: pairs of large ones, then best fit."""
    large, small = sorted((s for s in sizes if 3 * s > length), reverse=True), sorted((s for s in sizes if 3 * s <= length), reverse=True)
    out = []
    while large:
        s = large.pop(0)
        other = next((k for k, x in enumerate(large) if s + x <= length), None)
        out.append([s] if other is None else [s, large.pop(other)])
    for s in small:
        fits = [b for b in out if length - sum(b) >= s]
        if fits:
            min(fits, key=lambda b: length - sum(b)).append(s)
        else:
            out.append([s])
    return out


def planned(sizes, length):
    """The sequences of the plan, checked: gapless, within the length."""
    plan = best_fit.Plan(np.bincount(sizes, minlength=length + 1), length)
    seen, ranks = {}, []
    for s in sizes:
        ranks.append(seen.get(s, 0))
        seen[s] = ranks[-1] + 1
    sequence, offset = plan.place(np.array(sizes, np.int64), np.array(ranks, np.int64))
    out = {}
    for s, q, o in zip(sizes, sequence.tolist(), offset.tolist(), strict=True):
        out.setdefault(q, []).append((o, s))
    for held in out.values():
        held.sort()
        assert [o for o, _ in held] == [sum(s for _, s in held[:i]) for i in range(len(held))]
        assert sum(s for _, s in held) <= length
    assert len(out) == plan.sequences
    return [[s for _, s in held] for held in out.values()]


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_plain_loops(seed):
    rng = np.random.default_rng(seed)
    length = int(rng.choice([8, 30, 64, 1024]))
    sizes = np.clip(rng.choice([rng.integers(1, length + 1, 400), rng.geometric(6 / length, 400)]), 1, length)
    if seed % 3 == 0:
        sizes[:150] = sizes[0]  # many of one length
    rng.shuffle(sizes)
    got, want = planned(sizes.tolist(), length), plain(sizes.tolist(), length)
    assert sorted(map(sum, got)) == sorted(map(sum, want))  # of sequences with the same room either may be chosen
    assert all(sum(3 * s > length for s in b) <= 2 for b in got)


def most_pairs(sizes, length):
    """The largest matching by trying all."""
    best = 0
    for n in range(len(sizes) // 2, 0, -1):
        for chosen in itertools.combinations(range(len(sizes)), 2 * n):
            kept = sorted(sizes[i] for i in chosen)
            if all(kept[i] + kept[-1 - i] <= length for i in range(n)):
                return n
    return best


def test_matching_gives_as_many_pairs_as_there_can_be():
    rng = np.random.default_rng(4)
    for _ in range(60):
        sizes = rng.integers(11, 30, 8).tolist()
        assert sum(len(b) == 2 for b in planned(sizes, 30)) == most_pairs(sizes, 30)


def test_plan_is_small_and_tight():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 10**9, 1025)
    counts[0] = 0
    plan = best_fit.Plan(counts)
    least = -(-int((counts * np.arange(1025)).sum()) // 1024)
    assert plan.sequences <= 1.005 * least and len(plan.slots) < 20_000
    assert (plan.placed == counts).all()


def test_best_fit(spark):
    words = "one two three four five six seven eight nine ten".split()
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.choice([3, 40, 300, 700, 1023, 1024, 1025, 2600, 6000], 120))]
    rows += [(500, None), (500, ""), (None, "no id"), (None, "no id"), (501, "a\x00\x01<|endoftext|> b"), (502, "z" * 40000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, piece string, part long").repartition(5)
    tokenizer = Tokenizer.from_file(vocabulary())
    got = best_fit.best_fit(docs, with_ids=True).collect()
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    for pieces in held.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))] and sum(n for _, n in pieces) <= 1024
    want = sorted(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t in rows)
    docs_of, texts = {}, []
    for r in got:
        docs_of.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, bytes(r.ids)))
    for d, parts in docs_of.items():
        parts.sort()
        if d in (None, 500):  # two rows each, of one piece
            texts += [p[3] for p in parts]
            assert [p[:2] for p in parts] == [(0, 0)] * 2
            continue
        assert [p[0] for p in parts] == list(range(len(parts))) and [p[1] for p in parts] == [sum(p[2] for p in parts[:i]) for i in range(len(parts))]
        assert len(parts) == 1 or all(p[2] == 1024 for p in parts[1:])
        texts.append(b"".join(p[3] for p in parts))
    assert sorted(texts) == want
    least = -(-sum(r.length for r in got) // 1024)
    assert len(held) == len(plain([r.length for r in got], 1024)) <= 1.1 * least
    assert best_fit.best_fit(docs.limit(0)).count() == 0


def test_query_packs_whole_table(spark, data):
    sf = f"{data}/sf0.001"
    got = queries.QUERIES["op13_best_fit"](spark, sf)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in table(spark, sf, "documents").select("doc_id").collect()}
    assert len({r.sequence_id for r in rows}) == len(plain([r.length for r in rows], 1024))
