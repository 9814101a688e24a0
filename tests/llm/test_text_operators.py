import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer
from pyspark.sql import functions as F

from larkspan.llm import blocks, lines, packing, quality, queries, simhash, substrings, token_counts, token_files
from larkspan.llm.common import Words, settled, table
from larkspan.llm.tokens import Encoder, vocabulary
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string"


def thue_morse(n):
    """Two words of n letters a and b, each where the other has the other: polynomials modulo 2**64 can't tell them apart."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]


@pytest.fixture(scope="module")
def rows(data):
    """Some real texts, and nulls, empty and long texts, ties, repeated rows, odd white space."""
    import pyarrow.parquet as pq

    real = pq.read_table(f"{data}/sf0.001/documents.parquet").to_pylist()
    out = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in real]
    rng = random.Random(5)
    passage = " ".join(rng.choice("abcdefg") * rng.randint(1, 4) for _ in range(60))
    out += [(900, None, None, None), (901, "", "en", None), (902, " \n\t\n ", None, "s"), (None, "A line without an id here\nother", "en", "s"), (None, None, None, None)]
    twins = thue_morse(2048)
    out += [(920 + i, " ".join(["same"] * 34 + [w]), "en", "s") for i, w in enumerate(twins)] + [(922, " ".join(twins * 3), "en", "s"), (923, "hi <|endoftext|> you<|endoftext|>", "en", "s")]
    out += [(910, "A Line without an id HERE  \nx\nx\nx", "en", "s"), (911, f"x {passage} y", "en", "s"), (912, f"{passage} z {passage}", "en", "s"), (913, "w " * 5000, "de", "s")]
    out += [(914, "long" * 20000 + "\n" + passage, "de", "s"), (915, "don't  stop　 <|endoftext|> it's\x1c!a", "fr", "s")] * 2
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "extra", "extra") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return tuple((v is None, v) for v in x)


def same(got, want):
    assert sorted(got, key=key) == sorted(want, key=key)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_substring_dedup(docs, rows, empty):
    out = substrings.without_repeats(docs)
    assert {"lang", "kept"} <= set(out.columns) and out.schema["n_words"].dataType.typeName() == "long"
    got = [(r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept_text)) for r in out.collect()]
    same(got, brute.substring_dedup(pairs(rows)))
    spans = {r.doc_id: r.removed_spans for r in out.collect()}
    assert spans[911] == [[1, 60]] and spans[901] == []
    assert substrings.without_repeats(empty).count() == 0


def test_words_get_numbers_by_their_bytes():
    text = " ".join([*thue_morse(1024), "a", "b", "a", *thue_morse(1024), "b"]).encode()
    words = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    codes, first = words.distinct()
    assert len(first) == 4 and len(set(zip(codes.tolist(), text.split(), strict=True))) == 4
    one, two = words.wide_hashes()
    assert len(set(one.tolist())) == len(set(two.tolist())) == 4


def hot_rows():
    """A third of the rows without an id, a third of one id, one line in all of them, and one text very often."""
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))
    common, text = "This line is in every document", words(50)
    return [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"{common}\n{text if i % 5 == 0 else words(20)}") for i in range(300)]


@pytest.mark.parametrize("hot", [2, 1024])
def test_hot_ids_and_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(lines, "HOT", hot)
    rows = hot_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    size = sum(len(t) for _, t in rows)
    most = max(r["count"] for r in blocks.blocked(docs, "text", size).groupBy("_block").count().collect())
    assert most < 60  # of 300 rows; one block would have 100 of one id
    same([(r.doc_id, r.n_lines, r.n_dropped, brute.sha(r.text)) for r in lines.deduped_lines(docs).collect()], brute.line_dedup(rows))
    same([(r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept_text)) for r in substrings.without_repeats(docs).collect()], brute.substring_dedup(rows))


def test_line_dedup(docs, rows, empty):
    got = [(r.doc_id, r.n_lines, r.n_dropped, brute.sha(r.text)) for r in lines.deduped_lines(docs).collect()]
    same(got, brute.line_dedup(pairs(rows)))
    assert lines.deduped_lines(empty).count() == 0


def test_quality_counts(docs, rows, empty):
    out = quality.quality_rules(docs)
    assert set(docs.columns) <= set(out.columns)
    got = out.collect()
    same([(r.doc_id, *(r[c] for c in quality.STATS)) for r in got], [(d, *brute.stats(t)) for d, t in pairs(rows)])
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality.quality_rules(empty).count() == 0


def test_quantiles_of_large_groups(spark):
    """Beyond a sketch's size the quartiles are off by a small part of the rows' ranks at most."""
    rng = np.random.default_rng(8)
    n = 30000
    words = rng.integers(50, 5000, n)
    rows = [("en", None if i % 2 else "s", int(w), int(w * rng.integers(3, 9)), int(rng.integers(0, 40)), 0, int(w // rng.integers(2, 90))) for i, w in enumerate(words)]
    stats = spark.createDataFrame(rows, "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long").repartition(7)
    own = {r._source: r for r in quality.thresholds_of(stats).where("NOT _all").collect()}
    for source in ("s", None):
        mine = [r for r in rows if r[1] == source]
        values = np.sort([r[3] / r[2] for r in mine])
        found = own[source]
        gap = (found._high_word_length - found._low_word_length) / (2 * quality.FENCE + 1)  # the quartiles' distance
        for value, share in ((found._low_word_length + quality.FENCE * gap, 0.25), (found._high_word_length - quality.FENCE * gap, 0.75)):
            low, high = np.searchsorted(values, value - 1e-9) / len(values), np.searchsorted(values, value + 1e-9, "right") / len(values)
            assert low - 0.005 <= share <= high + 0.005
    kept = quality.judged(stats, quality.thresholds_of(stats))
    assert kept.count() == n and kept.where("kept").count() > n / 2


def test_simhash(docs, rows, empty):
    same([tuple(r) for r in simhash.near_duplicates(docs).collect()], brute.simhash(pairs(rows)))
    assert simhash.near_duplicates(empty).count() == 0
    clash = docs.selectExpr("doc_id", "text", "lang AS fingerprint", "source AS component_id", "n_words AS node")
    same([tuple(r) for r in simhash.near_duplicates(clash).collect()], brute.simhash(pairs(rows)))


def test_trie_finds_all_links():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 4)).astype(np.uint64)) if i else c for c in centre for i in range(20)]
    values = np.unique(np.array(near, np.uint64))
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= 2}
    got = {(min(a, b), max(a, b)) for x, y in simhash.trie_links(values, np.zeros(len(values), np.int64)) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert got == want


def test_split_routes_lose_no_link(spark):
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 1 << 62))
    prints = sorted({centre ^ sum(1 << int(b) for b in set(rng.integers(0, 64, 3))) for _ in range(150)} | {int(x) for x in rng.integers(0, 1 << 62, 50)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    nodes = {r.node: r.root for r in simhash.components(simhash.links(df, most=5)).collect()}
    got = [nodes.get(p, p) for p in signed]
    want = brute.groups(prints)
    assert len(set(got)) == len(set(want)) and len(set(zip(got, want, strict=True))) == len(set(got))


def test_components_of_a_chain(spark):
    nodes = list(range(0, 60))
    random.Random(1).shuffle(nodes)
    edges = [(min(a, b), max(a, b)) for a, b in zip(nodes, nodes[1:], strict=False)] + [(100, 101)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "low long, high long")).collect()}
    assert got == {n: 0 for n in range(1, 60)} | {101: 100} or {k: v for k, v in got.items() if k != v} == {n: 0 for n in range(1, 60)} | {101: 100}


@pytest.fixture(scope="module")
def whole():
    """The ids of a text by the library alone, as its file says."""
    tokenizer = Tokenizer.from_file(vocabulary())
    return lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")


def odd_texts(n, seed):
    """Texts of words, signs and every code point up to U+00FF, with some of other scripts and planes."""
    rng = random.Random(seed)
    some = [chr(c) for c in range(256)]
    scripts = [*"żłółćßñ", *"бвг", *"한국어", *"漢字", *"العربية", *"देवनागरी", "\u0301", "\u200b", "\ufeff", "\U0001f600", "\u2028", "\u3000", "_", "'s", "<|endoftext|>", "word", "Two", "12"]
    return ["".join(rng.choice(some if rng.random() < 0.5 else scripts) if rng.random() < 0.6 else rng.choice([" ", "a", "the", "word", "."]) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_ids_of_every_character(spark, whole, tmp_path):
    texts = [f"{a}{chr(c)}{b}" for c in range(256) for a, b in (("word", ""), ("", "word"), (" word.", " two"), ("é", "é"))] + odd_texts(4000, 3)
    encode = Encoder(vocabulary())
    for t in texts:
        assert encode.ids(t).tolist() == whole(t)[:-1].tolist(), repr(t)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same([(r.doc_id, bytes(r.ids)) for r in token_files.token_files(docs, f"file://{tmp_path}").collect()], [(i, whole(t).tobytes()) for i, t in enumerate(texts)])
    got = {}
    for r in packing.packed(docs, with_ids=True).collect():
        got.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert all(b"".join(x for _, x in sorted(got[i])) == whole(t).tobytes() for i, t in enumerate(texts))
    trees = token_counts.edited(token_counts.trees(docs).withColumn("edits", F.lit(None).cast(token_counts.EDITS))).collect()
    assert all(r.n_tokens == len(whole(texts[r.doc_id])) - 1 for r in trees)


def test_token_files(spark, docs, rows, empty, whole, tmp_path):
    got = token_files.token_files(docs, f"file://{tmp_path}").collect()
    assert len(got) == len(rows)
    by = sorted(got, key=lambda r: r.start)
    assert [r.doc_id is None for r in by][:2] == [True, True] and [r.doc_id for r in by[2:]] == sorted(r[0] for r in rows if r[0] is not None)
    assert [r.start for r in by] == [sum(x.n_tokens for x in by[:i]) for i in range(len(by))]
    want = [(d, len(whole(t)), zlib.crc32(whole(t).tobytes())) for d, t in pairs(rows)]
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], want)
    assert token_files.token_files(empty, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("begin", ["", "texts that all begin with the same words, as letters do: "])
def test_a_frequent_id_is_spread_over_files(spark, tmp_path, begin):
    rows = [(None if i % 3 else 7, f"{begin}{i * 7919 % 1000:03d} text of its own") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = token_files.write(docs, f"file://{tmp_path}", vocabulary()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) >= 3 and max(f.n_docs for f in files) < 600  # of null ids there are 600
    got = sorted(token_files.read(spark.createDataFrame(files), f"file://{tmp_path}").collect(), key=lambda r: r.start)
    encode = Encoder(vocabulary())
    want = [(d, encode.ids(t).astype("<u4").tobytes() + bytes(4)) for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[1]))]
    assert [r.doc_id for r in got] == [d for d, _ in want]
    if not begin:  # else they're in the order of their hashes
        assert [bytes(r.ids) for r in got] == [x for _, x in want]
    same([(r.doc_id, bytes(r.ids)) for r in got], want)


def test_codes_give_random_access():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 300, 3000), rng.integers(0, 60000, 3000), [0, 255, 256, 65535, 65536, 2**32 - 1], rng.integers(0, 200, 700)]).astype(np.uint32)
    reader = token_files.Reader(token_files.pack([7, None], np.array([100, len(ids)]), ids))
    assert reader.doc_ids == [7, None] and reader.ends.tolist() == [100, len(ids)]
    for i in [*range(0, len(ids), 97), *range(5998, 6010)]:
        assert reader.token(i) == ids[i]
    for a, b in ((0, len(ids)), (511, 513), (5990, 6010), (6500, 6500), (1, 2)):
        assert (reader.tokens(a, b) == ids[a:b]).all()


def test_packing(docs, rows, empty, whole):
    got = packing.packed(docs, with_ids=True, block=7).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and 0 < r.length <= 1024
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at.bit_count() == 1
    once = [d for d in by_doc if d is not None and sum(r[0] == d for r in rows) == 1]
    for d, t in pairs(rows):
        if d in once:
            pieces = sorted(by_doc[d], key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in pieces) == whole(t).tobytes() and all(r.doc_tokens == len(whole(t)) for r in pieces)
    assert sum(r.length for r in got) == sum(len(whole(t)) for _, t in pairs(rows))
    assert packing.packed(empty).count() == 0
    clash = docs.selectExpr("doc_id", "text", "lang AS start", "source AS sequence_id", "n_words AS ids")
    assert packing.packed(clash, block=7).count() == len(got) and packing.packed(clash).columns == [c.split()[0] for c in packing.PIECES.split(", ")]


def by_plain_loops(sizes, length=1024):
    """The assignment, one item and one sequence at a time."""
    room = packing.rooms(sum(sizes), length).tolist()
    full, spent, out = list(room), [0.0] * len(room), []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        start, left = 0, sizes[item]
        while left:
            open_ = [q for q in range(len(room)) if room[q] >= left] or [q for q in range(len(room)) if room[q]]
            best = min(open_, key=lambda q: (spent[q], q))
            n = min(left, room[best])
            out.append((item, start, n, best, full[best] - room[best]))
            room[best] -= n
            spent[best] += packing.cost(n)
            start, left = start + n, left - n
    return out


def test_packing_equals_plain_loops():
    for seed in range(5):
        sizes = np.random.default_rng(seed).integers(1, 1024, 80)
        assert packing.balanced(sizes) == by_plain_loops(sizes.tolist())


def test_packing_balances_costs():
    sizes = np.random.default_rng(1).integers(1, 1024, 500)
    pieces = packing.balanced(sizes)
    spent = {}
    for _, _, n, q, _ in pieces:
        spent[q] = spent.get(q, 0) + packing.cost(n)
    full = [spent[q] for q, room in enumerate(packing.rooms(int(sizes.sum()))) if room == 1024]
    assert max(full) < 1.25 * min(full) and len(pieces) < 1.6 * len(sizes)


def applied(text, edits):
    for start, removed, added in edits:
        start = max(0, min(start or 0, len(text)))
        text = text[:start] + (added or "") + text[start + (removed or 0) :]
    return text


def test_edited_counts(docs, rows, empty, whole):
    rng = random.Random(2)
    texts = [t or "" for _, t in pairs(rows)]

    def edits(t):
        return [(rng.randint(0, len(t) + 3), rng.choice([0, 0, 1, 7, 300]), rng.choice(["", " ", "x", "  ", "\n", " a b", "'s", " ", "zz! ?", "<|endoftext|>", "many words of a long piece " * 9])) for _ in range(8)]

    spark = docs.sparkSession
    for leaf in (1, 3, 16):
        state = token_counts.trees(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), leaf=leaf)
        now = list(texts)
        for _ in range(2):  # the second batch of edits reads the first one's leaves, no text
            made = [edits(t) for t in now]
            lists = spark.createDataFrame(list(enumerate(made)), f"_doc long, edits {token_counts.EDITS}")
            state = settled(token_counts.edited(state.join(lists, state["doc_id"] == lists["_doc"]), leaf=leaf), "test-trees")
            got = {r.doc_id: r for r in state.collect()}
            for i, t in enumerate(now):
                assert got[i].n_tokens_before == len(whole(t)) - 1
                now[i] = applied(t, made[i])
                assert (got[i].n_tokens, got[i].n_chars) == (len(whole(now[i])) - 1, len(now[i])), (i, leaf)
                assert "".join(got[i].leaves) == now[i] and sum(got[i].tokens) == got[i].n_tokens
    assert max(r.n_reencoded for i, r in got.items() if now[i].count(" w w w w") > 500) < 5000  # of 10,000 code points, by eight edits
    none = token_counts.trees(docs).withColumn("edits", F.lit(None).cast(token_counts.EDITS))
    assert all(r.n_tokens == r.n_tokens_before and r.n_reencoded == 0 for r in token_counts.edited(none).collect())
    assert token_counts.trees(empty).count() == 0 and token_counts.edited(token_counts.trees(empty).withColumn("edits", F.lit(None))).count() == 0


def test_leaves_are_split(whole):
    encode = Encoder(vocabulary())
    tree = token_counts.Tree([], [], [])
    for k in range(50):
        tree.edit(5 * k, 0, f" w{k} and <more> of it" * 5, token_counts.counter(encode), 4)
    assert max(len(x.split()) for x in tree.leaves) <= 9 and tree.tokens[1] == len(whole("".join(tree.leaves))) - 1


def test_edits_as_rows(spark, whole):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "left alone"), (None, "no id")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 0, 0, "B "), (1, 1, 0, 4, "A "), (2, 1, 5, 5, "new"), (2, 2, None, None, None), (2, 3, -4, 0, "x"), (None, 1, 0, 0, "y"), (9, 1, 0, 0, "z")], "doc_id long, seq int, start int, removed int, added string")
    rows = token_counts.with_edits(token_counts.trees(docs).withColumn("edits", F.lit("old")), edits)
    got = {r.doc_id: ("".join(r.leaves), r.n_tokens) for r in token_counts.edited(rows).collect()}
    want = {1: "B A two three", 2: "xnew", 3: "left alone", None: "no id"}
    assert got == {d: (t, len(whole(t)) - 1) for d, t in want.items()}


def test_queries_over_whole_tables(spark, data):
    sf = f"{data}/sf0.001"
    n = table(spark, sf, "documents").count()
    for name in ("op2_token_files", "op4_substring_dedup", "op7_simhash", "op8_line_dedup", "op9_quality_rules", "op10_token_counts"):
        assert queries.QUERIES[name](spark, sf).count() == n, name
