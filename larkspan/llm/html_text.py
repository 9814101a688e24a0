"""Main text of web pages (operator 1): each host's suffix arrays find what its pages repeat; markup guards the article.

A page is parsed once, into blocks. What stands in an article (or main) and isn't marked as a menu, header, footer,
sidebar, notice, advert, form or comment is guarded: it's the text, however often the host repeats it. Of a
page without such a part the candidates are the blocks of containers named for content or, without these, all
that isn't marked. From candidates goes what the host repeats: the token streams of all that isn't guarded
are put one after another by host and their suffixes sorted; runs of tokens found on PAGES or more
pages of different content are boilerplate. A block mostly covered by runs of RUN tokens or more goes; from other blocks
only runs of LONG tokens or more do, so a sentence that several stories share stays.

A host may have a third of all pages, so no task gets a whole host. Tasks sort the suffixes of their own pages. Suffixes that
begin alike are neighbours, however long what they share: so one array gives the runs of RUN tokens and those of LONG, and
for each the task passes on one entry with up to PAGES pages that it is on; entries merge by host and run. A maximal
repeat of any length from RUN (LONG) on covers the tokens that its runs of RUN (LONG) tokens cover, and these are on all of its
pages, so this finds what one suffix array of the whole host finds.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import mixed, settled

#: Tokens of the shortest run that counts as repeated and of the shortest that goes from any block, and pages of different content that it's on.
RUN, LONG, PAGES = 8, 24, 3
#: Share of a block's tokens from which on it goes whole.
MOSTLY = 0.75
#: Groups over which the pages that have a run are dealt.
SALTS = 16

# Names of HTML, and names that sites give to parts of a page.
SKIPPED = {"script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "head", "title", "nav", "footer", "aside", "form", "button", "select", "option", "textarea", "input", "dialog", "menu", "audio", "video"}
IN_LINES = {"button", "select", "option", "input", "object", "svg", "audio", "video", "canvas"}
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg")
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "caption", "section", "article", "main", "blockquote", "pre", "figure", "figcaption", "hr", "header", "address", "body", "html", "center", "details", "summary", "fieldset", "hgroup", "search"} | SKIPPED - IN_LINES - {"script", "style", "noscript", "template", "iframe", "textarea"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "td", "th", "time", "tt", "u", "var"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
CLOSE_BY_THEMSELVES = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "h1", "h2", "h3", "h4", "h5", "h6"}
LISTED = {"li", "dd", "tr", "td", "th", "dt"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "status", "note"}
NAMES = {"nav", "navbar", "navigation", "menu", "sidebar", "aside", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "promo", "promotion", "sponsor", "sponsored", "footer", "header", "masthead", "comment", "comments", "disqus", "replies", "respond", "share", "sharing", "social", "breadcrumb", "breadcrumbs", "related", "recommended", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "widget", "toolbar", "pagination", "pager", "skip"}
NOT_ARTICLES = {"comment", "comments", "reply", "replies", "related", "recommended", "promo", "promotion", "sponsor", "sponsored", "ad", "ads", "advert", "adverts", "advertisement", "teaser", "teasers"}
LAST_PART = {"nav", "navbar", "navigation", "menu", "sidebar", "footer", "comments", "advert", "adverts", "advertisement", "ads", "breadcrumb", "breadcrumbs", "newsletter", "popup", "modal", "masthead"}
FIRST_PART = {"ad", "ads", "advert", "cookie", "cookies", "comment", "comments", "nav", "menu", "sidebar", "footer", "newsletter", "breadcrumb", "social", "banner"}
HOLDERS = {"slot", "box", "bar", "list", "area", "section", "banner", "block", "unit", "container", "wrap", "wrapper", "form", "links", "notice", "consent", "signup", "menu", "buttons", "thread", "panel"}
SITE, OF_SITE = {"site", "page", "global", "top"}, {"header", "banner", "notice", "search", "login"}
DENIED = {"has", "no", "with", "without", "is", "not", "hide", "show", "toggle"}
HEADINGS, CONTAINERS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}, {"div", "section", "aside", "ul", "ol"}
WRAPPERS = {"header", "masthead", "widget", "toolbar", "overlay", "form"}
CONTENT = {"article", "content", "post", "entry", "story", "main", "maincontent", "articlebody"}
CONTENT_OF, CONTENT_PART = CONTENT | {"page", "site", "blog", "text"}, {"content", "body", "text", "main"}
IN_NAMED, IN_MAIN, IN_ARTICLE = 1, 2, 4
GUARDED, CANDIDATE, OUTSIDE = 0, 1, 2

# A tag ends at the first > outside a quoted value; a quote counts only after =, and a < outside one shows that this is no tag.
# What was read in vain is text as a whole, so no string of broken tags is read twice, and a tag may have any number of attributes.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><"']*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|=|[^<>=]++)*+)(>?)""")
_CUT_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*+)(\s[^<>=]*+=[^<>]*+|\s*+/?)\Z")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!|;|$)")
_ENDS = {t: re.compile(rf"</{t}\s*+>|\Z", re.I) for t in RAW}


def names_boilerplate(name: str) -> bool:
    """Whether a whole class or id, in lower case, is a name that sites give to boilerplate."""
    if name in NAMES:
        return True
    parts = re.split(r"[-_]+", name)
    if not 2 <= len(parts) <= 3 or parts[0] in DENIED:
        return False
    return parts[-1] in LAST_PART or parts[0] in FIRST_PART and parts[-1] in HOLDERS or parts[0] in SITE and parts[-1] in OF_SITE


def names_wrapper(name: str) -> bool:
    """Whether a name of boilerplate is one that sites also give to what is around a whole article."""
    parts = re.split(r"[-_]+", name)
    return name in WRAPPERS or parts[0] in SITE and parts[-1] == "header"


def names_content(name: str) -> bool:
    parts = re.split(r"[-_]+", name)
    return name in CONTENT or len(parts) == 2 and parts[0] in CONTENT_OF and parts[1] in CONTENT_PART


def _named(tag: str, attributes: str, zone: int) -> tuple[bool, bool, bool, bool]:
    """Whether the attributes name boilerplate, content, and the main part, and whether a name of boilerplate may be around an article; zone: what is around the tag.

    In an article or main part, a class or an id names boilerplate only on a container (of menus as a whole name); a
    heading's names none in any content.
    """
    boiler = content = main = False
    soft = True
    seen = set()
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind in seen:
            continue
        seen.add(kind)
        names = value.split()
        if kind == "role":
            named = ROLES & set(names)
            main |= "main" in names
            content |= bool({"main", "article"} & set(names))
            boiler, soft = boiler or bool(named), soft and named <= {"banner", "form"}
        elif kind == "hidden" or kind == "aria-hidden" and value.strip() == "true" or kind == "style" and _UNSEEN.search(value):
            boiler, soft = True, False
        elif kind in ("class", "id", "itemprop"):
            if tag == "article":
                named = NOT_ARTICLES & set(names)
            elif zone >= IN_MAIN:
                named = {n for n in names if n in NAMES or names_boilerplate(n) and not n.endswith("menu")} if tag in CONTAINERS else set()
            elif zone and tag in HEADINGS:
                named = set()
            else:
                named = {n for n in names if names_boilerplate(n)}
            boiler, soft = boiler or bool(named), soft and all(map(names_wrapper, named))
            content |= any(map(names_content, names))
    return boiler, content and not boiler, main and not boiler, boiler and soft


def blocks_of(page: str) -> list[tuple[int, bool, str]]:
    """(zone, boilerplate, text) of each block with text, in one pass over the page. Zone: bits for a container named for content, main, article.

    A form, a header and what is named like one are boilerplate unless an article, a main part or a container named for content stands in them; a form
    also isn't if it holds more than half of the page's text. Buttons, lists to choose from, drawings and the like go from a line without ending its block.
    """
    found: list[tuple[int, bool, int, str]] = []
    wraps: list[list] = [[-1, False, 0, False]]  # of each form or header: the one around it, content in it, text in it, whether a form; the first: none
    stack: list[tuple[str, int, bool, int, bool]] = []  # tag; zone, boilerplate, wrap, out of its line: of it and what is around it
    open_: dict[str, int] = {}  # how often a tag is on the stack
    text: list[str] = []
    at, end = 0, len(page)
    nothing = ("", 0, False, 0, False)

    def flush() -> None:
        _, zone, boiler, wrap, muted = stack[-1] if stack else nothing
        if text and not muted:
            if words := " ".join(html.unescape("".join(text)).split()):
                found.append((zone, boiler, wrap, words))
            text.clear()

    def close(depth: int) -> None:
        for tag, *_ in stack[depth:]:
            open_[tag] -= 1
        del stack[depth:]

    while at < end:
        start = page.find("<", at)
        muted = bool(stack) and stack[-1][4]
        if not muted and start != at:
            text.append(page[at:start] if start >= 0 else page[at:])
        if start < 0:
            break
        following = page[start + 1 : start + 2]
        if following in ("!", "?"):
            comment = page.startswith("<!--", start)
            stop = page.find("-->", start + 4) if comment else page.find(">", start)
            at = end if stop < 0 else stop + (3 if comment else 1)
            continue
        m = _TAG.match(page, start)
        if not m or not m[4]:
            cut = _CUT_TAG.match(page, start)
            if cut and cut[1].lower() in BLOCKS | INLINE | VOID | SKIPPED:
                break  # the page ends in a tag
            at = m.end() if m else start + 1
            if not muted:
                text.append(page[start:at])
            continue
        at = m.end()
        tag = m[2].lower()
        if tag in RAW and not m[1] and not m[3].endswith("/"):
            at = _ENDS[tag].search(page, at).end()
            continue
        if (tag == "br" or tag in ("td", "th")) and not muted:
            text.append(" ")
        if m[1]:
            if open_.get(tag):
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                if any(t in BLOCKS for t, *_ in stack[depth:]) and not stack[depth][4]:
                    while stack[-1][4]:
                        close(len(stack) - 1)  # left open in a line
                    flush()
                close(min(depth, len(stack)))
            elif tag in BLOCKS:
                flush()
            continue
        if tag in BLOCKS:
            flush()
            if stack and stack[-1][0] in CLOSE_BY_THEMSELVES and not (stack[-1][0] in LISTED and tag not in LISTED):
                close(len(stack) - 1)
        if tag in VOID or m[3].endswith("/"):
            continue
        _, zone, boiler, wrap, muted = stack[-1] if stack else nothing
        named, content, main, soft = _named(tag, m[3], zone) if m[3].strip() else (False, False, False, False)
        if tag in BLOCKS or tag in SKIPPED or named and tag in ("span", "a", "td"):
            skip = tag in SKIPPED or named and tag not in ("html", "body", "main") or tag == "header" and not zone
            if not skip:
                if tag == "article":
                    zone |= IN_ARTICLE
                elif tag == "main" or main:
                    zone |= IN_MAIN
                elif content and tag in ("div", "section"):
                    zone |= IN_NAMED
                else:
                    content = False
                if (content or tag in ("article", "main")) and not boiler:
                    around = wrap
                    while around and not wraps[around][1]:
                        wraps[around][1] = True
                        around = wraps[around][0]
            elif tag not in BLOCKS:
                muted = True
            elif (soft if named else tag in ("form", "header")) and not boiler:
                wraps.append([wrap, False, 0, tag == "form"])
                wrap = len(wraps) - 1
            else:
                boiler = True
            stack.append((tag, zone, boiler, wrap, muted))
            open_[tag] = open_.get(tag, 0) + 1
    while stack and stack[-1][4]:
        close(len(stack) - 1)
    flush()
    total = 0
    for _, boiler, wrap, words in found:
        if not boiler:
            total += len(words)
            wraps[wrap][2] += len(words)
    for wrap, (around, _, size, _) in reversed(list(enumerate(wraps))):
        if wrap and around:
            wraps[around][2] += size
    kept = [True]
    for around, content, size, form in wraps[1:]:
        kept.append(kept[around] and (content or form and 2 * size > total))
    return [(zone, boiler or not kept[wrap], words) for zone, boiler, wrap, words in found]


def roles_of(blocks: list[tuple[int, bool, str]]) -> tuple[list[int], bool]:
    """What each block is: guarded (main text by markup), a candidate that repetition judges, or outside; and whether candidates stand in containers named for content.

    Main holds the text if there's more in it than in articles beside it, and of main its articles if they have at
    least half of it; else the articles do, unless a container named for content holds more than twice their text.
    """
    size = [0] * 8
    for zone, boiler, t in blocks:
        if not boiler:
            size[zone] += len(t)
    total = lambda bits, without=0: sum(n for z, n in enumerate(size) if z & bits == bits and not z & without)
    main, both, beside = total(IN_MAIN), total(IN_MAIN | IN_ARTICLE), total(IN_ARTICLE, IN_MAIN)
    if main and main >= beside:
        wanted, role = (IN_MAIN | IN_ARTICLE if 2 * both >= main else IN_MAIN), GUARDED
    elif beside and total(IN_NAMED) <= 2 * (beside + both):
        wanted, role = IN_ARTICLE, GUARDED
    elif total(IN_NAMED):
        wanted, role = IN_NAMED, CANDIDATE
    else:
        wanted, role = 0, CANDIDATE
    return [OUTSIDE if boiler or zone & wanted != wanted else GUARDED if zone & IN_ARTICLE else role for zone, boiler, _ in blocks], wanted == IN_NAMED


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*).*", r"\1", (url or "").strip().lower(), flags=re.S) if url and "://" in url else ""


def suffix_array(tokens: np.ndarray, owner: np.ndarray, depths: tuple[int, ...] = (RUN, LONG)) -> tuple[np.ndarray, list[np.ndarray]]:
    """All suffixes of the streams, sorted by their first tokens (the greatest depth; a stream's end comes first), and their ranks at each depth.

    Prefix doubling: suffixes sorted by 1, 2, 4, ... tokens, each round from the ranks of the one before; a depth between two
    powers takes the ranks of the lower one twice, overlapping. At each depth equal suffixes are neighbours.
    """
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    deep, found = 1, []
    for depth in sorted(depths):
        while deep < depth:
            step = min(deep, depth - deep)
            ahead = np.zeros(n, np.int64)
            if n > step:
                ahead[:-step] = np.where(owner[step:] == owner[:-step], rank[step:], 0)
            _, rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)
            rank = rank.astype(np.int64) + 1
            deep += step
        found.append(rank)
    return np.argsort(rank, kind="stable"), found


def repeats(order: np.ndarray, rank: np.ndarray, owner: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """From a suffix array: the places where `depth` tokens are left in their stream, in its order; and which start like the one before."""
    n = len(owner)
    whole = np.zeros(n, bool)
    if n >= depth:
        whole[: n - depth + 1] = owner[depth - 1 :] == owner[: n - depth + 1]
    order = order[whole[order]]
    return order, np.concatenate([[False], rank[order][1:] == rank[order][:-1]]) if len(order) else np.zeros(0, bool)


def stream(texts: list[str]) -> np.ndarray:
    """A 64-bit value of each token of some blocks, in one stream."""
    return np.array([xxhash.xxh3_64_intdigest(w) for t in texts for w in t.split()], np.uint64)


def run_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of so many tokens."""
    n = max(0, len(values) - length + 1)
    out = np.full(n, length, np.uint64)
    for k in range(length):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + values[k : k + n])
    return out


def finished(blocks: list[str], roles: list[int], marked: bool, at: list[int] | None = None, long_at: list[int] | None = None) -> tuple[str, int]:
    """A page's text, and the tokens that host repeats cover; at, long_at: where repeated runs of RUN and of LONG tokens start in the stream of what isn't guarded."""
    judged = [b.split() if r != GUARDED else [] for b, r in zip(blocks, roles, strict=True)]
    gone = np.zeros(sum(map(len, judged)), bool)
    for a in at or []:
        gone[a : a + RUN] = True
    long = np.zeros(len(gone), bool)
    for a in long_at or []:
        long[a : a + LONG] = True
    kept, seen, lost = [], 0, False
    for block, role, words in zip(blocks, roles, judged, strict=True):
        here = slice(seen, seen + len(words))
        seen += len(words)
        if role == GUARDED:
            kept.append(block)
        elif role == CANDIDATE:
            if gone[here].sum() >= MOSTLY * len(words):
                lost = True
            elif long[here].any():
                kept.append(" ".join(w for w, g in zip(words, long[here].tolist(), strict=True) if not g))
            else:
                kept.append(block)
    if marked and lost and not any(kept):  # a page that the host has several times, not boilerplate
        kept = [b for b, r in zip(blocks, roles, strict=True) if r == CANDIDATE]
    return "\n\n".join(k for k in kept if k), int(gone.sum())


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) and n_repeated (tokens that the host repeats, of pages that repetition judges) of each page.

    Character references are decoded; white space inside a block is one space; blocks stand in page order with two \\n
    between. Null or empty html gives ''; a null url is a host of its own; a < that starts no tag is text; pages cut short
    in the middle are read as far as they go; repeated rows appear each, and pages of the same content count as one for
    repetition; other columns are left out; an empty table stays empty.
    """
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    ids = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string"

    kept = [("host", pa.string()), ("content", pa.int64()), ("text", pa.string()), ("blocks", pa.list_(pa.string())), ("roles", pa.binary()), ("marked", pa.bool_()), ("judged", pa.string())]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A page's text where markup decides, its blocks and their roles where repetition does; and all that isn't guarded in one text."""
        for batch in batches:
            rows = []
            for url, raw in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                found = blocks_of(raw or "")
                roles, marked = roles_of(found)
                texts = [t for _, _, t in found]
                content = xxhash.xxh3_64_intdigest("\n".join(texts)) - (1 << 63)
                judged = "\n".join(t for t, r in zip(texts, roles, strict=True) if r != GUARDED)
                if CANDIDATE in roles:
                    rows.append((host_of(url), content, None, texts, bytes(roles), marked, judged))
                else:
                    rows.append((host_of(url), content, finished(texts, roles, marked)[0], None, None, None, judged))
            columns = [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kept)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *columns], names=["page_id", "url", *[c for c, _ in kept]])

    def by_host(batch: pa.RecordBatch) -> dict[str, list[tuple[int, np.ndarray]]]:
        """Contents and their streams, each content once, by host."""
        out: dict[str, dict[int, str]] = {}
        for host, content, text in zip(*(batch.column(c).to_pylist() for c in ("host", "content", "judged")), strict=True):
            out.setdefault(host, {}).setdefault(content, text)
        return {host: [(c, stream([t])) for c, t in found.items()] for host, found in out.items()}

    def sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, streams in by_host(batch).items():
                values = np.concatenate([s for _, s in streams])
                owner = np.repeat(np.arange(len(streams)), [len(s) for _, s in streams])
                suffixes, ranks = suffix_array(values, owner)
                for length, rank in zip((RUN, LONG), ranks, strict=True):
                    order, again = repeats(suffixes, rank, owner, length)
                    if not len(order):
                        continue
                    pairs = np.unique((np.cumsum(~again) - 1) * len(streams) + owner[order])  # of a run and a page, each once
                    run, page = np.divmod(pairs, len(streams))
                    firsts = np.flatnonzero(np.concatenate([[True], np.diff(run) != 0]))
                    contents = np.array([c for c, _ in streams], np.int64)[page]
                    on = [contents[a : min(a + PAGES, b)].tolist() for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(pairs)], strict=True)]
                    hashes = run_hashes(values, length)[order[np.flatnonzero(~again)]]
                    yield pa.RecordBatch.from_pydict({"host": pa.array([host] * len(on), pa.string()), "run": pa.array(hashes.view(np.int64)), "contents": pa.array(on, pa.list_(pa.int64()))})

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, streams in by_host(batch).items():
                for content, values in streams:
                    for length in (RUN, LONG):
                        h = run_hashes(values, length).view(np.int64)
                        yield pa.RecordBatch.from_pydict({"content": pa.array([content] * len(h), pa.int64()), "host": pa.array([host] * len(h), pa.string()), "run": pa.array(h), "at": pa.array(np.arange(len(h)), pa.int32()), "long": pa.array(np.full(len(h), length == LONG))})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [finished(b, list(r), m, at, long_at) for b, r, m, at, long_at in zip(*(batch.column(c).to_pylist() for c in ("blocks", "roles", "marked", "at", "long_at")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["page_id", "url", "text", "n_repeated"])

    parsed = settled(pages.mapInArrow(parse, f"{ids}, host string, content long, text string, blocks array<string>, roles binary, marked boolean, judged string"), "parsed-pages", "zstd")
    done = parsed.where("text IS NOT NULL").select("page_id", "url", "text", F.lit(0).cast("long").alias("n_repeated"))
    open_ = parsed.where("text IS NULL")
    if not open_.isEmpty():
        judged = lambda rows: rows.where("judged <> ''").select("host", "content", "judged")
        runs = judged(parsed).mapInArrow(sort_suffixes, "host string, run long, contents array<long>").groupBy("host", "run").agg(F.array_distinct(F.flatten(F.collect_list("contents"))).alias("contents"))
        repeated = runs.where(F.size("contents") >= PAGES).select("host", "run")
        # A run that a third of all pages have is dealt over SALTS groups of pages.
        placed = judged(open_).mapInArrow(starts, "content long, host string, run long, at int, long boolean").withColumn("salt", F.pmod("content", F.lit(SALTS)).cast("int"))
        met = placed.join(repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "run", "salt"])
        places = lambda long: F.array_sort(F.collect_set(F.when(long, F.col("at"))))
        covered = settled(met.groupBy("host", "content").agg(places(~F.col("long")).alias("at"), places(F.col("long")).alias("long_at")), "repeated-runs")
        cleaned = open_.select("page_id", "url", "host", "content", "blocks", "roles", "marked").join(covered, ["host", "content"], "left")
        done = done.unionByName(cleaned.select("page_id", "url", "blocks", "roles", "marked", "at", "long_at").mapInArrow(finish, f"{ids}, text string, n_repeated long"))
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated")
