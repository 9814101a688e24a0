"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERED = str.maketrans(UPPER, UPPER.lower())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(rows, k=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def line_dedup(rows, least=10):
    key = lambda x: x.strip(SPACE).translate(LOWERED)
    big = 1 << 63
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(big if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        me = big if d is None else d
        kept = [x for x in lines if len(key(x)) < least or len(held[key(x)]) < 2 or min(held[key(x)]) == me]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def stats(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def fingerprint(text, k=3):
    words = WORD.findall((text or "").translate(LOWERED))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    votes = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def groups(prints, errors=2):
    """The component of each position by comparing all pairs."""
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= errors:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


def simhash(rows, k=3):
    prints = [fingerprint(t, k) for _, t in rows]
    top = groups(prints)
    least = {}
    for (d, _), r in zip(rows, top, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, f"{p:016x}", least.get(r)) for (d, _), p, r in zip(rows, prints, top, strict=True)]


def adaptive(rows, fence=None):
    """The ids of (id, lang, source, stats) that base rules and fences around the quartiles of their language and source keep."""
    from larkspan.llm import quality

    def measures(s):
        n, chars, symbols, lines, repeats = s
        return {"word_length": chars / max(n, 1), "symbol_share": symbols / max(chars, 1), "dup_lines_per_word": lines / max(n, 1), "repeat_share": repeats / max(n, 1)}

    def quartiles(group):
        at = lambda v, q: sorted(v)[max(0, -(-q * len(v) // 4) - 1)]
        return {k: (at([m[k] for m in group], 1), at([m[k] for m in group], 3)) for k in quality.MEASURES}

    groups, every = defaultdict(list), [measures(s) for *_, s in rows]
    for (_, lang, source, _), m in zip(rows, every, strict=True):
        groups[lang, source].append(m)
    fences = {g: quartiles(ms if len(ms) >= quality.LEAST_GROUP else every) for g, ms in groups.items()}
    kept = set()
    for (d, lang, source, s), m in zip(rows, every, strict=True):
        q = fences[lang, source]
        gap = {k: max(q[k][1] - q[k][0], quality.MEASURES[k]) * quality.FENCE for k in q}
        if s[0] >= 50 and 2 * s[4] <= s[0] and all(m[k] <= q[k][1] + gap[k] for k in q) and m["word_length"] >= q["word_length"][0] - gap["word_length"]:
            kept.add(d)
    return kept


def contains(text, item, k=5, share=0.8):
    """Whether `share` of the item's distinct five-word shingles are in the text."""
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    shingles = lambda w: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    own = shingles(words(item))
    return bool(own) and len(own & shingles(words(text))) >= share * len(own) - 1e-9


def subword_buckets(text):
    """The bucket of each subword of a text: its words and their n-grams of 3 to 5 bytes with the spaces around them."""
    m32, out = (1 << 32) - 1, []
    for word in WORD.findall((text or "").translate(LOWERED)):
        raw = word.encode()
        out.append((xxhash.xxh3_128_intdigest(raw) & ((1 << 64) - 1)) >> 48)
        spaced = b" " + raw + b" "
        for n in (3, 4, 5):
            for i in range(len(spaced) - n + 1):
                h = 0
                for b in spaced[i : i + n]:
                    h = (h * 0x01000193 + b) & m32
                h = ((h ^ (h >> 15)) * (0x85EBCA6B + 2 * n)) & m32
                out.append((((h ^ (h >> 13)) * 0xC2B2AE35) & m32) >> 16)
    return out
