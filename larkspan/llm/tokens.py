"""Token ids of whole texts by the tokenizers library.

A byte-level BPE never merges across pre-tokens, and between a character that isn't white space
and one that is there is always a pre-token boundary. So a text falls into chunks `\\s*\\S+`, each
of which has the same ids alone as in its text. (A special token's string holds no white space, so it's in
one chunk, and the library gives it its id as it does in a whole text.) Texts repeat chunks a lot: a worker
finds a slice's distinct chunks, looks them up by their bytes, encodes those that it doesn't know, and keeps
a bounded number, the most used.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pandas as pd

from larkspan.llm.common import SPACE, Words, slices

#: Chunks of which a worker keeps the ids.
KEPT = 400_000
#: Bytes of text that a task encodes at a time: the more, the fewer chunks are looked up twice.
TOKEN_BYTES = 2 << 20
#: Words of which it keeps the ids apart from the signs after them.
HEADS = 150_000
VOCABULARY = "byte_bpe_50k.json"
END = 0
#: White space as the tokenizer's pattern has it.
WHITE = r" \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: One pre-token of letters, then one of other signs without an apostrophe.
PLAIN = re.compile(r"( ?[^\W\d_]+)([^\w\s']*)\Z")
#: The printable stand-ins that byte-level vocabularies use for bytes.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
STAND_IN = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}
SPACE_SHOWN = chr(STAND_IN[0x20])
LEAD = np.zeros(256, bool)
LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def wide_space(buf: np.ndarray) -> np.ndarray:
    """Where white space beyond ASCII starts (U+0085, U+00A0, U+1680, U+2000 to 200A, U+2028, U+2029, U+202F, U+205F, U+3000)."""
    at = np.flatnonzero(LEAD[buf])
    if not len(at):
        return at
    a = buf[at]
    b, c = buf[np.minimum(at + 1, len(buf) - 1)], buf[np.minimum(at + 2, len(buf) - 1)]
    general = (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
    return at[(a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & general | (a == 0xE3) & (b == 0x80) & (c == 0x80)]


class Encoder:
    """Encodes texts; keeps the ids of frequent chunks for the next texts."""

    def __init__(self, path: str, plain_specials: bool = False) -> None:
        """plain_specials: strings of special tokens are ordinary text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.model = self.tokenizer.model
        self.start()

    def start(self) -> None:
        self.heads: dict[str, bytes] = {}
        self.entry: dict[bytes, int] = {}  # a chunk's place in the arrays, in their order
        self.hits, self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def chunk(self, chunk: str) -> bytes:
        """A chunk's ids as unsigned 32-bit numbers. One word with signs after it, the usual case, goes to the model without the pre-tokenizer."""
        if (chunk[1:] if chunk[0] == " " else chunk).isalpha():
            return self.part(chunk)
        if (plain := PLAIN.match(chunk)) and plain[1].lstrip(" ").isalpha():
            head, tail = plain.groups()
            return self.part(head) + self.part(tail) if tail else self.part(head)
        return array("I", self.tokenizer.encode_batch_fast([chunk], add_special_tokens=False)[0].ids).tobytes()

    def part(self, token: str) -> bytes:
        if (ids := self.heads.get(token)) is None:
            if len(self.heads) >= HEADS:
                self.heads.clear()
            if token.isascii() and token.isprintable():
                shown = SPACE_SHOWN + token[1:] if token[0] == " " else token
            else:
                shown = token.encode().decode("latin-1").translate(STAND_IN)
            found = self.model.tokenize(shown)
            if sum(len(t.value) for t in found) != len(shown):
                raise ValueError(f"the vocabulary has no token for a byte of {token!r}")
            ids = self.heads[token] = array("I", [t.id for t in found]).tobytes()
        return ids

    def slowly(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.chunk, CHUNK.findall(text))), np.uint32)

    def forget(self, needed: np.ndarray, room: int) -> np.ndarray:
        """Keeps the entries that are needed now, and of the others the most used, so that `room` more may come; where each one kept is now."""
        rank = self.hits.copy()
        rank[needed] = np.iinfo(np.int64).max
        count = min(len(rank), max(len(needed), KEPT // 2 - room))
        stay = np.zeros(len(rank), bool)
        stay[np.argsort(-rank, kind="stable")[:count]] = True
        size = self.size[stay]
        at = np.cumsum(size) - size
        self.flat = self.flat[np.arange(int(size.sum())) + np.repeat(self.at[stay] - at, size)]
        self.entry = {k: i for i, k in enumerate(k for k, s in zip(self.entry, stay.tolist(), strict=True) if s)}
        self.hits, self.at, self.size = self.hits[stay] // 2, at, size
        return np.cumsum(stay) - 1

    def places(self, chunks: list[bytes]) -> np.ndarray:
        """The entries of distinct chunks, learned if they are new."""
        entry = self.entry
        found = np.array([entry.get(c, -1) for c in chunks], np.int64)
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return found
        if len(self.entry) + len(missing) > KEPT:
            known = found >= 0
            moved = self.forget(found[known], len(missing))
            found[known] = moved[found[known]]
        new = [chunks[i] for i in missing.tolist()]
        ids = [self.chunk(c.decode()) for c in new]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        found[missing] = np.arange(len(self.entry), len(self.entry) + len(new))
        self.entry.update(zip(new, found[missing].tolist(), strict=True))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.size, self.hits = np.concatenate([self.size, size]), np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), np.uint32)])
        return found

    def chunks(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words]:
        """For each word of the texts: the entry of the chunk that it ends, and where that chunk starts."""
        words = Words(buf, offsets)
        if not len(words.starts):
            return np.zeros(0, np.int64), words.starts, words
        begins = np.concatenate([[0], words.ends[:-1]])
        heads = words.first[:-1][np.diff(words.first) > 0]
        begins[heads] = offsets[:-1][np.diff(words.first) > 0]
        gap = words.starts - begins
        before = np.where(gap == 1, buf[np.minimum(begins, len(buf) - 1)], 0).astype(np.int64)
        wide: dict[bytes, int] = {}
        for i in np.flatnonzero(gap > 1).tolist():
            before[i] = 256 + wide.setdefault(buf[begins[i] : words.starts[i]].tobytes(), len(wide))
        codes, _ = pd.factorize(words.distinct()[0] * (256 + len(wide)) + before)
        one = np.zeros(int(codes.max()) + 1, np.int64)
        one[codes] = np.arange(len(codes))
        raw = buf.tobytes()
        entry = self.places([raw[a:b] for a, b in zip(begins[one].tolist(), words.ends[one].tolist(), strict=True)])
        self.hits[entry] += np.bincount(codes, minlength=len(entry))
        return entry[codes], begins, words

    def hard(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts end in white space or hold such beyond ASCII, so that chunks of bytes don't do."""
        last = offsets[1:]
        out = (np.diff(offsets) > 0) & SPACE[buf[np.maximum(last - 1, 0)]] if len(buf) else np.zeros(len(last), bool)
        if len(wide := wide_space(buf)):
            out[np.searchsorted(offsets, wide, "right") - 1] = True
        return out

    def encode(self, buf: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after another (`end` after each if it's given), and where each text's start (one more entry)."""
        hard = self.hard(buf, offsets)
        apart = {int(i): self.slowly(buf[offsets[i] : offsets[i + 1]].tobytes().decode()) for i in np.flatnonzero(hard)}
        if apart:
            keep = np.repeat(~hard, np.diff(offsets))
            buf, offsets = buf[keep], np.concatenate([[0], np.cumsum(np.where(hard, 0, np.diff(offsets)))])
        entry, _, words = self.chunks(buf, offsets)
        size = self.size[entry]
        before = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.arange(int(before[-1])) + np.repeat(self.at[entry] - before[:-1], size)]
        at = before[words.first]
        if apart:
            parts = [apart.get(i, flat[at[i] : at[i + 1]]) for i in range(len(hard))]
            at, flat = np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate(parts)
        if end is not None:
            flat, at = np.insert(flat, at[1:], end), at + np.arange(len(at))
        return flat.astype(np.uint32, copy=False), at

    def ids(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return self.encode(raw, np.array([0, len(raw)]))[0]

    def batches(self, buf: np.ndarray, offsets: np.ndarray, end: int | None = None):
        """(first row, row after the last, ids, starts) of runs of rows."""
        for i, j, part, at in slices(buf, offsets, TOKEN_BYTES):
            yield i, j, *self.encode(part, at, end)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """One for each worker process, for a worker serves many tasks."""
    key = path, plain_specials
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, plain_specials)
    return _ENCODERS[key]
