import random
import time
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspan.llm import decontamination, html_text, queries, toxicity
from larkspan.llm.common import table
from larkspan.llm.tokens import vocabulary
from tests.llm import brute
from tests.llm.test_near_copies import by_all_pairs


def page(main, nav="Home News", foot="All rights"):
    return f"<html><head><title>t</title><script>if (a<b) '</p>'</script></head><body><nav><a>{nav}</a></nav><div class='ad'>Buy</div>{main}<footer>{foot}</footer></body></html>"


def by_markup(html):
    found = html_text.blocks_of(html)
    roles, marked = html_text.roles_of(found)
    return html_text.finished([t for _, _, t in found], roles, marked)[0]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<article><h1>T &amp; U</h1><p>One\n two&nbsp;three<br>four<p>Five <b>si</b>x</article>", "T & U\n\nOne two three four\n\nFive six"),
        ("<main><p>a</p><aside>x</aside><form>y</form><p>b<script>var s='<p>';</script></main>", "a\n\nb"),
        ("<div id='content'><p>a</p><div class='comments'><p>c</p></div><p class='notice'>n<p>b</div>", "a\n\nb"),
        ("<article><p>a</p><section class='comments'><p>c</p></section></article><article class='comment'>z</article>", "a"),
        ("<article><p>cut sho", "cut sho"),
        ("<!-- <article>no</article> --><article><p>&lt;yes&gt;</article>", "<yes>"),
    ],
)
def test_markup_settles_a_page(html, want):
    assert by_markup(page(html)) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<article><div style='overflow:hidden'>a</div><p data-id='menu' title='hidden class=menu'>b</p></article>", "a\n\nb"),
        ("<article><h1 class='entry-header'>t</h1><section id='related-work'><h2 id='how-to-share-files'>h</h2><p class='notice'>p</p></section></article>", "t\n\nh\n\np"),
        ("<div class='post'><h1 class='entry-header'>t</h1><p>a</p></div>", "t\n\na"),
        ("<article><p>a</p><div class='x share'>s</div><ul id='menu'><li>m</ul><p hidden>h</p><p style='color: red; display : none'>d</p><p style='visibility:hidden'>v</p><p HIDDEN>u</p></article>", "a"),
    ],
)
def test_only_what_marks_boilerplate_goes(html, want):
    assert by_markup(page(html)) == want


STORY = "The story goes on and on, as stories do. " * 8


@pytest.mark.parametrize(
    "around",
    ["<form id='aspnetForm'><div class='content'>{}</div></form>", "<form><article>{}</article></form>", "<header><article>{}</article></header>", "<div class='page-header'><article>{}</article></div>", "<div class='widget'><article>{}</article></div>",
     "<form method=post><input type=hidden name=x>{}<select><option>A<option>B</select></form><div>All rights</div>", "<header class='masthead'><form><main>{}</main></form></header>", "<div role='banner'><main>{}</main></div>"],
)
def test_forms_and_headers_around_an_article_are_no_boilerplate(around):
    got = by_markup(around.format(f"<p>{STORY}</p><p>End.</p>")).split("\n\n")
    assert got[:2] == [STORY.strip(), "End."] and len(got) <= 2 + ("All rights" in around)


def test_forms_and_headers_beside_an_article_are():
    html = f"<header><h1>Site</h1></header><form>Search <input></form><form class='comment-form'><article>{STORY}</article></form><div class='comments'><article>c</article></div><div><p>{STORY}</p></div>"
    assert by_markup(html) == STORY.strip()


@pytest.mark.parametrize("part", ["<section class='user-comments'><p>bad</p></section>", "<div class='comments-area'>bad</div>", "<div class='comment-list'><article>bad</article></div>", "<ol class='comment-list'><li>bad</ol>", "<div id='ad-slot'>bad</div>", "<div class='cookie-notice'>bad</div>", "<div class='newsletter-box'>bad</div>"])
def test_comments_and_adverts_in_an_article_go(part):
    assert by_markup(f"<article><p>{STORY}</p>{part}<p>End.</p></article>") == f"{STORY.strip()}\n\nEnd."


@pytest.mark.parametrize(
    ("line", "want"),
    [("Press <button>OK</button> now", "Press now"), ("Pick <select><option>a<option>b</select> it", "Pick it"), ("E is <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> here", "E is mc2 here"), ("a <span hidden>x</span> b<script>'<p>'</script> c <svg><text>t</text></svg>d", "a b c d"),
     ("left <button>open", "left"), ("a <button><b>x</b> y</button>b", "a b"), ("<div " + " ".join(f"data-a{i}='x'" for i in range(2500)) + ">many</div>", "many"), ("1 <2 and a <b c='<i>q</i>' end", "1 <2 and a <b c='<i>q</i>' end")],
)
def test_parts_of_a_line(line, want):
    assert by_markup(f"<article><p>{line}</p><p>next</p></article>") == f"{want}\n\nnext"


def test_a_long_page_that_is_well_formed():
    parts = [f"Part {i} of a page that goes on" for i in range(60000)]
    start = time.time()
    assert by_markup(page(f"<article>{''.join(f'<div class=x><p>{p}</p></div>' for p in parts)}</article>")) == "\n\n".join(parts)
    assert time.time() - start < 20


def test_suffix_array_finds_repeated_runs():
    rng = np.random.default_rng(0)
    streams = [rng.integers(0, 5, rng.integers(0, 40)) for _ in range(30)]
    tokens = np.concatenate(streams).astype(np.uint64)
    owner = np.repeat(np.arange(30), [len(s) for s in streams])
    suffixes, ranks = html_text.suffix_array(tokens, owner, (2, 4, 7))
    ends = np.cumsum([len(s) for s in streams])[owner]
    keys = [tuple(tokens[i : min(i + 7, ends[i])]) for i in suffixes]
    assert sorted(suffixes.tolist()) == list(range(len(tokens))) and keys == sorted(keys)
    for depth, rank in zip((2, 4, 7), ranks, strict=True):
        order, again = html_text.repeats(suffixes, rank, owner, depth)
        assert sorted(order.tolist()) == [i for i in range(len(tokens)) if i + depth <= ends[i]]
        keys = [tuple(tokens[i : i + depth]) for i in order]
        assert keys == sorted(keys) and again.tolist() == [i > 0 and keys[i] == keys[i - 1] for i in range(len(keys))]
        assert depth > 2 or again.any()


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<main>the long story stands here</main><article>Teaser</article>", "the long story stands here"),
        ("<main><p>intro</p><article>the whole long story</article></main>", "the whole long story"),
        ("<article class='entry has-header'>x</article>", "x"),
        ("<article class='post no-sidebar shadow'>x</article><article class='teaser'>y</article>", "x"),
        ("<div class='content no-sidebar'>x</div><div>y</div>", "x"),
        ("<div class='page-header'>h</div><div id='cookie-notice'>k</div><p>main</p><div class='site-footer'>f</div><div class='ad-slot'>a</div>", "main"),
        ("<article><p>if a <b and c then d</p><p>e</p></article>", "if a <b and c then d\n\ne"),
        ("<article><label>lab</label><div id='share-price'>p</div><div id=related-work>r</div></article>", "lab\n\np\n\nr"),
        ("<article><p>a <a href='f'>b</a> <a href=\"cut", "a b"),
        ("<article><p title=it's>x</p><p title=\"it's >\">z</p></article>", "x\n\nz"),
    ],
)
def test_main_text_stays(html, want):
    assert by_markup(f"<html><body>{html}") == want


@pytest.mark.parametrize("html", ["<a " * 300000 + '"', '<a b="' * 160000, "<div>" * 100000 + "</section>" * 50000, '<a b="<a"' * 110000 + ">", "<" * 1000000, "<a b='" * 90000 + '<a b="' * 90000])
def test_broken_tags_take_no_longer(html):
    start = time.time()
    html_text.blocks_of(html)
    assert time.time() - start < 10


def by_counting(rows):
    """Texts and covered tokens, from sets of the contents that each run of tokens is on."""
    read = []
    for _, url, html in rows:
        found = html_text.blocks_of(html or "")
        roles, marked = html_text.roles_of(found)
        texts = [t for _, _, t in found]
        tokens = [(w, k) for k, (t, r) in enumerate(zip(texts, roles, strict=True)) if r != html_text.GUARDED for w in t.split()]
        read.append((html_text.host_of(url), texts, roles, marked, tokens))
    on = defaultdict(set)
    run = lambda tokens, i, n: tuple(w for w, _ in tokens[i : i + n])
    for host, texts, _, _, tokens in read:
        for n in (8, 24):
            for i in range(len(tokens) - n + 1):
                on[host, run(tokens, i, n)].add(tuple(texts))
    out = []
    for host, texts, roles, marked, tokens in read:
        gone, long = ({j for i in range(len(tokens) - n + 1) if len(on[host, run(tokens, i, n)]) >= 3 for j in range(i, i + n)} for n in (8, 24))
        kept = []
        for k, (t, r) in enumerate(zip(texts, roles, strict=True)):
            own = [j for j, (_, b) in enumerate(tokens) if b == k]
            if r == html_text.GUARDED:
                kept.append(t)
            elif r == html_text.CANDIDATE and len(gone & set(own)) < 0.75 * len(own):
                kept.append(" ".join(tokens[j][0] for j in own if j not in long))
        if marked and not any(kept):
            kept = [t for t, r in zip(texts, roles, strict=True) if r == html_text.CANDIDATE]
        out.append(("\n\n".join(x for x in kept if x), len(gone) if html_text.CANDIDATE in roles else 0))
    return out


def test_repetition_equals_counting(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [said(rng.choice([5, 9, 12, 40])) for _ in range(8)]

    def one(k):
        parts = [said(rng.randint(0, 30)) if rng.random() < 0.5 else rng.choice(shared) for _ in range(rng.randint(1, 6))]
        parts += [f"{rng.choice(shared)} {said(9)} {rng.choice(shared)}"]
        body = "".join(f"<p>{p}</p>" for p in parts)
        return rng.choice([body, f"<div class='content'>{body}</div><p>{rng.choice(shared)}</p>", f"<article>{body}</article><p>{rng.choice(shared)}</p>", f"<nav>{rng.choice(shared)}</nav>{body}<footer>{shared[0]}</footer>"])

    rows = [(k, rng.choice(["http://a.example/x", "https://b.example/y", None]), one(k)) for k in range(120)]
    rows += [(500 + k, "http://a.example/copy", rows[0][2]) for k in range(5)] + [(0, rows[0][1], rows[0][2]), (600, "http://a.example/", None), (None, "http://a.example/", ""), (601, "http://a.example/", "<p>" + "word " * 200000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").repartition(5)
    got = [(r.page_id, r.url, r.text, r.n_chars, r.n_repeated) for r in html_text.main_texts(pages).collect()]
    want = [(p, u, t, len(t), n) for (p, u, _), (t, n) in zip(rows, by_counting(rows), strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(n > 0 for *_, n in want) > 60 and sum(t != by_markup(h or "") for (_, _, h), (_, _, t, _, _) in zip(rows, want, strict=True)) > 20
    assert html_text.main_texts(pages.limit(0)).count() == 0


def test_a_sentence_of_several_stories_stays(spark):
    same = "the minister said on Monday that nothing of all this was true at all"
    rows = [(i, f"http://h.example/{i}", f"<p>Home News Sport Weather Travel Money Jobs Shop Help</p><p>Story {i} begins with {i} lines of its own news{i}. {same}, and so{i} it goes on for {i} days more.</p>") for i in range(4)]
    got = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].startswith(f"Story {i} begins") and same in got[i] for i in range(4))


def test_short_repeats_one_after_another_are_no_long_one(spark):
    """Three sentences that each stand on three pages, but together on one, stay in a block with more beside them; a paragraph that three pages have goes from it."""
    said = lambda k: " ".join(f"{k}{i}" for i in range(10))
    own = lambda k: " ".join(f"own{k}x{i}" for i in range(40))
    paragraph = " ".join(f"all{i}" for i in range(30))
    texts = [f"{own(0)} {said('a')} {said('b')} {said('c')}"] + [f"{own(10 + k)} {said(s)}" for k, s in enumerate("aabbcc")] + [f"{own(20 + k)} {paragraph} {own(30 + k)}" for k in range(3)]
    rows = [(k, f"http://h.example/{k}", f"<p>{t}</p>") for k, t in enumerate(texts)]
    got = {r.page_id: r for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got[0].text == texts[0] and got[0].n_repeated == 30
    assert all(got[k].text == texts[k] for k in range(7))
    assert all(got[7 + k].text == f"{own(20 + k)} {own(30 + k)}" and got[7 + k].n_repeated == 30 for k in range(3))


@pytest.fixture(scope="module")
def mixed(spark):
    item = " ".join(f"word{i}" for i in range(20))
    partly = " ".join(f"word{i}" for i in range(2, 20))
    little = " ".join(f"word{i}" for i in range(10))
    rows = [(1, f"before {item} after"), (2, f"Before, {item.upper().replace(' ', ', ')}!"), (3, partly), (4, little), (5, None), (6, ""), (None, item), (7, "z " * 30000 + item), (8, item), (8, item), (9, "a b c")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, item), (2, item), (3, "a b c"), (4, None), (None, "none of these words is anywhere at all")], "item_id long, text string")
    return docs, bench


def test_decontamination(mixed):
    docs, bench = mixed
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_shingles) for r in decontamination.contained(docs, bench).collect()}
    want = {(d, i): (16, 16) for d in (1, 2, None, 7, 8) for i in (1, 2)} | {(3, i): (14, 16) for i in (1, 2)}
    assert got == want
    kept = decontamination.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 9]
    more = docs.unionByName(docs.sparkSession.createDataFrame([(None, "clean text without an id", "x"), (None, None, "x"), (1, "clean text of an id that leaks elsewhere", "x")], docs.schema))
    assert sorted((r.doc_id is not None, r.text) for r in decontamination.decontaminated(more, bench).where("doc_id IS NULL OR doc_id = 1").collect() if r.text) == [(False, "clean text without an id"), (True, "clean text of an id that leaks elsewhere")]
    assert decontamination.contained(docs.limit(0), bench).count() == 0 and decontamination.contained(docs, bench.limit(0)).count() == 0


def test_sketches_beyond_a_broadcast(mixed, monkeypatch):
    docs, bench = mixed
    want = sorted(map(tuple, decontamination.contained(docs, bench).collect()), key=repr)
    monkeypatch.setattr(decontamination, "MOST_ENTRIES", 0)
    monkeypatch.setattr(decontamination, "MOST_ITEM_BYTES", 0)
    assert sorted(map(tuple, decontamination.contained(docs, bench).collect()), key=repr) == want


def test_a_training_step_follows_the_gradient():
    rng = np.random.default_rng(1)
    features = [(np.sort(rng.choice(50, 12, replace=False)).astype(np.uint32), rng.integers(1, 5, 12)) for _ in range(6)] + [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
    labels, rarity = np.array([0, 1, 1, 0, 0, 1, 1]), rng.random(60) + 0.5
    vectors, weights, bias = rng.normal(size=(60, 4)), rng.normal(size=(4, 2)), rng.normal(size=2)

    def loss(vectors, weights, bias):
        out = 0.0
        for (ids, counts), label in zip(features, labels, strict=True):
            mean = sum((n * rarity[i] * vectors[i] for i, n in zip(ids, counts, strict=True)), np.zeros(4)) / max(1, counts.sum())
            logits = mean @ weights + bias
            out -= logits[label] - np.log(np.exp(logits).sum())
        return out / len(labels)

    after = [x.copy() for x in (vectors, weights, bias)]
    toxicity.step(*after, toxicity.Batch(features, labels, rarity), 0.01)
    for which, rate in ((0, 0.01), (1, 0.001), (2, 0.001)):
        for at in np.ndindex(after[which].shape):
            moved = [[x.copy() for x in (vectors, weights, bias)] for _ in range(2)]
            for m, d in zip(moved, (1e-5, -1e-5), strict=True):
                m[which][at] += d
            slope = (loss(*moved[0]) - loss(*moved[1])) / 2e-5
            assert abs(after[which][at] - ((vectors, weights, bias)[which][at] - rate * slope)) < 1e-9


def test_the_sample_has_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, f"bad words {i}") for i in range(300)] + [(2, "good words"), (3, "good " * 90000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0)], "doc_id long, toxic int")
    few = toxicity.learned(docs, labels, sample=4)
    assert abs(few[1] - np.log(1 / 2)) < 1.5  # one toxic of three or two: clean ids aren't crowded out
    alone = toxicity.learned(docs, labels, sample_bytes=0)
    assert not np.isfinite(alone[0]).all() or abs(alone[1] - np.log(1e-3 / (1 - 1e-3))) < 1e-6


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    plain = ["river", "stone", "green", "window", "table", "garden", "yellow", "paper"]
    texts = [" ".join(rng.choice(plain, 60)) + (" you scumbag" if i % 3 == 0 else "") for i in range(400)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(1000, None, None), (None, "", None), (1001, "river scumbaag stone", None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels)
    assert out.columns.count("score") == 1
    got = {r.doc_id: r for r in out.collect()}
    tested = [i for i in range(400) if got[i].held_out]
    assert 60 < len(tested) < 140 and np.mean([got[i].predicted == (i % 3 == 0) for i in tested]) > 0.95
    assert got[1000].score == got[None].score and not got[None].held_out
    assert got[1001].score > max(got[i].score for i in tested if i % 3)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    long = spark.createDataFrame([(1, "river stone " * 200000), (2, "river stone " * 200000 + "scumbag " * 200000)], "doc_id long, text string")
    clean, toxic = toxicity.scored(long, toxicity.learned(docs, labels)).orderBy("doc_id").collect()
    assert clean.score < toxic.score  # the end of a text counts too
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_scores_equal_plain_loops(spark):
    rng = np.random.default_rng(4)
    weights, bias = rng.normal(0, 1, 1 << toxicity.BUCKET_BITS), -0.7
    texts = [None, "", " \n", "a", "Some Words\tof a text, some words", "ÄÖ über 漢字 x", "zz " * 500, "long" * 3000]
    docs = spark.createDataFrame([(i, t, 9.0) for i, t in enumerate(texts)], "doc_id long, text string, other double").coalesce(1)
    for r in toxicity.scored(docs, (weights, bias)).collect():
        buckets = brute.subword_buckets(texts[r.doc_id])
        odds = bias + (sum(float(np.float32(weights[b])) for b in buckets) / len(buckets) if buckets else 0.0)
        assert abs(r.score - 1 / (1 + np.exp(-odds))) < 1e-9 and r.predicted == int(r.score >= 0.3) and r.other == 9.0


def test_toxicity_of_the_held_out_fold(spark, data):
    out = queries.QUERIES["op5_toxicity"](spark, f"{data}/sf0.1").join(table(spark, f"{data}/sf0.1", "labels"), "doc_id").where("held_out")
    r = out.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"), F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("caught")).first()
    assert r.right > 0.95 and r.caught > 0.85


def test_pipeline(spark, data):
    sf = f"{data}/sf0.001"
    docs = table(spark, sf, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.settled(stage(spark, before, sf), "test")
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns and docs.count() <= before.count()
    before, after = seen["quality rules"]
    stats = {r.doc_id: brute.stats(r.text) for r in before.collect()}
    assert all(stats[r.doc_id][0] >= 50 and 2 * stats[r.doc_id][4] <= stats[r.doc_id][0] for r in after.collect())
    assert {r.doc_id for r in after.collect()} == brute.adaptive([(r.doc_id, r.lang, r.source, stats[r.doc_id]) for r in before.collect()])
    before, after = seen["line dedup"]
    want = {d: s for d, _, _, s in brute.line_dedup([(r.doc_id, r.text) for r in before.collect()])}
    got = after.collect()
    assert {r.doc_id: brute.sha(r.text) for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    before, after = seen["near duplicates"]
    assert {r.doc_id for r in after.collect()} == set(by_all_pairs([(r.doc_id, r.text) for r in before.collect()]).values())
    before, after = seen["benchmark decontamination"]
    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    want = {r.doc_id for r in before.collect() if not any(brute.contains(r.text, x) for x in items)}
    assert {r.doc_id for r in after.collect()} == want and len(want) < before.count()
    before, after = seen["packing"]
    pieces = {}
    for r in after.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    tokenizer = Tokenizer.from_file(vocabulary())
    assert {d: b"".join(x for _, x in sorted(p)) for d, p in pieces.items()} == {r.doc_id: np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 0], "<u4").tobytes() for r in before.collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    odd = spark.createDataFrame([(None, None, None, None, None, "k"), (1, "x y", "en", "s", 3, "k")], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert set(stage(spark, odd, sf).columns) == set(odd.columns)
        assert stage(spark, odd.limit(0), sf).count() == 0
