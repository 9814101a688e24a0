import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from larkspan.llm import alignment, queries
from larkspan.llm.common import table
from larkspan.llm.tokens import STAND_IN, vocabulary
from tests.llm.test_text_operators import odd_texts

TEXTS = [None, "", " ", "  ", "\n", "a", " a", "a ", "two words", "a  b   c", "line\nnext\n\n line", "tab\tand\x0bmore\x0c", "\r", "x\r\ny\r\r z();\r\n {\r", "ends \r", "<|endoftext|> <s> x </s><unk>", "don't it's we'll 'sblock'", "é ñ ü ß 漢字 한국어 العربية", "\x00a\x01 b\x7f\x80", "with ▁ sign", "▁", "x　y z w\u0085", "﻿bom", "😀 emoji 👩‍👩‍👧", "<0x41> <0x0A>", "12345 67,890.12", "http://example.com/a?b=c&d=e", "supercalifragilistic" * 30, "a" * 700, " " * 50 + "x" + " " * 33]


@pytest.fixture(scope="module")
def plain():
    """(ids of A, ids of B, groups, links) by the untouched libraries and loops over bytes; None where they don't fit."""
    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(alignment.PIECES))
    back = {chr(v): b for b, v in STAND_IN.items()}

    def of(text):
        if not text:
            return None
        want = (" " + text).encode()
        enc = t.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(back[c] for c in t.id_to_token(i))) for i in enc.ids]
        b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            return None
        at_a = [k for k, (_, x) in enumerate(a) for _ in x]
        at_b = [k for k, (_, x) in enumerate(b) for _ in x]
        links = sorted(set(zip(at_a, at_b, strict=True)))
        ends_a, ends_b = np.cumsum([len(x) for _, x in a]).tolist(), np.cumsum([len(x) for _, x in b]).tolist()
        groups, i, j = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(f"{','.join(str(k) for k, _ in a[i:x])}|{','.join(str(k) for k, _ in b[j:y])}")
            i, j = x, y
        return len(a), len(b), groups, [(a[p][0], b[q][0]) for p, q in links]

    return of


def expected(rows, plain):
    each = [(d, plain(t)) for d, t in rows]
    count = Counter(x for _, p in each if p for x in p[3])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for d, p in each:
        if p is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((d, p[0], p[1], len(p[2]), len(p[3]), sum(count[x] == most[x[1]] for x in p[3]), sum(count[x] for x in p[3]), hashlib.sha256(";".join(p[2]).encode()).hexdigest()))
    return out, count, most


def key(r):
    return tuple((v is None, v) for v in r)


@pytest.mark.parametrize("seed", range(20))
def test_gallop(seed):
    rng = np.random.default_rng(seed)
    long = np.cumsum(rng.integers(1, 9, int(rng.integers(1, 3000))))
    short = np.unique(rng.integers(1, long[-1] + 1, int(rng.integers(0, len(long) + 1))))
    if seed % 4 == 0:
        long, short = np.sort(rng.choice(np.arange(1, 10**6), 500, False)), np.arange(1, 200)
    assert alignment.gallop(short, long).tolist() == np.searchsorted(long, short).tolist()


def test_alignment(spark, plain, monkeypatch):
    rng = random.Random(7)
    words = "the alignment of tokenizers isn't quite what one would think it is antidisestablishmentarianism".split()
    texts = TEXTS + odd_texts(400, 5) + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(40)] + ["same text here"] * 30
    rows = [(None if i % 50 == 7 else i // 2, t) for i, t in enumerate(texts)]
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(alignment, "PAIR_ROWS", 64)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_a int, pair string").repartition(3)
    want, count, most = expected(rows, plain)
    got = alignment.alignment(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(w[1] == 0 for w in want) >= 4
    ids = {(r.a_id, r.b_id): (r.n_links, r.is_best) for r in alignment.links_of_ids(docs).collect()}
    assert ids == {x: (n, n == most[x[1]]) for x, n in count.items()}
    assert alignment.alignment(docs.limit(0)).count() == 0


def test_query_over_whole_table(spark, data, plain):
    sf = f"{data}/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = queries.QUERIES["op12_alignment"](spark, sf).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows, plain)[0], key=key)
