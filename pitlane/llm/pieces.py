"""Splitting whole texts into pre-tokens with array operations, and a bounded per-worker cache of their ids.

The split is that of the byte-level pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
worked out from character classes of whole batches at once: runs of one class are pieces, a run's preceding
single space belongs to it, white space before a run gives up its last character, and an apostrophe that
starts a piece takes a contraction's letters.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

from pitlane.llm.common import bounds, mix64, powers, ragged_index, slices

GAP = 0x110000  # stands between texts; no character has this code
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
UNIT_CHARS = 500_000


@lru_cache(maxsize=1)
def newest_classes() -> np.ndarray:
    """Class of each code point in the newest Unicode tables here: letter, number, white space or other; GAP has 0."""
    codes = np.delete(np.arange(GAP, dtype="<u4"), np.s_[0xD800:0xE000])
    text = codes.tobytes().decode("utf-32-le")
    out = np.full(GAP + 1, OTHER, np.uint8)
    out[GAP] = 0
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[codes[m.start():m.end()]] = kind
    return out


def library_classes(joins) -> np.ndarray:
    """The classes that a tokenizer library's own Unicode tables give. Libraries differ only in characters that
    younger Unicode versions assigned: joins(strings) says for each two-character string whether the library
    keeps it as one piece, and is asked about those."""
    out = newest_classes().copy()
    young = [c for c in np.flatnonzero((out == LETTER) | (out == NUMBER)).tolist()
             if unicodedata.ucd_3_2_0.category(chr(c)) == "Cn"]
    as_letter, as_number = joins(["a" + chr(c) for c in young]), joins(["1" + chr(c) for c in young])
    out[young] = np.where(as_letter, LETTER, np.where(as_number, NUMBER, OTHER))
    return out


def units(text: str, limit: int = UNIT_CHARS) -> list[str]:
    """A text in parts of about `limit` characters, cut only where white space follows something else (there a
    piece starts whatever comes later, so the parts' pieces are the text's)."""
    if len(text) <= limit:
        return [text]
    out, start = [], 0
    cut = re.compile(r"(?<=\S)\s")
    while len(text) - start > limit and (m := cut.search(text, start + limit)):
        out.append(text[start:m.start()])
        start = m.start()
    return [*out, text[start:]]


def split(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, first byte of each piece, length of each piece, pieces before each text)."""
    gap = np.array([GAP], "<u4").tobytes()
    cp = np.frombuffer(b"".join(x for t in texts for x in (t.encode("utf-32-le"), gap)), "<u4")
    kind = classes[cp]
    n = len(cp)
    starts = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    starts[1:] |= kind[1:] == 0
    # White space that a run of another class follows: its last character stands apart, or goes to the run if it is a space.
    after = np.flatnonzero(starts[1:] & (kind[:-1] == SPACE) & (kind[1:] != 0)) + 1
    starts[after - 1] = True
    starts[after[cp[after - 1] == 0x20]] = False
    # Contractions.
    at = np.flatnonzero((cp[:-1] == 0x27) & starts[:-1] & (kind[1:] == LETTER))
    if len(at):
        one, two = cp[at + 1], cp[np.minimum(at + 2, n - 1)]
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        size[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))] = 2
        at, size = at[size > 0], size[size > 0]
        starts[at + 1] = False
        starts[at + 1 + size] = True
    width = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + ((cp >= 0x10000) & (cp != GAP))
    width[cp == GAP] = 1
    first_char = np.flatnonzero(starts)
    byte_at = bounds(width)
    first = byte_at[first_char]
    length = np.diff(np.append(first, byte_at[-1]))
    real = kind[first_char] != 0
    per_text = np.cumsum(real)[~real]
    buf = np.frombuffer(b"".join(x for t in texts for x in (t.encode(), b"\0")), np.uint8)
    return buf, first[real], length[real], np.concatenate([[0], per_text])


def piece_keys(buf: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys a piece: its bytes themselves up to 16, two polynomial hashes beyond."""
    words = np.ndarray((len(buf),), "<u8", np.concatenate([buf, np.zeros(16, np.uint8)]).tobytes(), strides=(1,))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    k1 = words[first] & masks[np.minimum(length, 8)]
    k2 = np.zeros(len(first), np.uint64)
    two = np.flatnonzero(length > 8)
    k2[two] = words[np.minimum(first[two] + 8, len(buf) - 1)] & masks[np.minimum(length[two] - 8, 8)]
    long = np.flatnonzero(length > 16)
    if len(long):
        n = length[long]
        at = bounds(n)[:-1]
        place = np.arange(int(n.sum())) - np.repeat(at, n)
        value = buf[ragged_index(first[long], n)].astype(np.uint64) + np.uint64(0x1F3)
        k1[long], k2[long] = (mix64(np.add.reduceat(value * powers(base, int(n.max()))[place], at))
                              for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
    return k1, k2


class PieceCache:
    """Pre-tokens seen by this worker, found by open addressing over arrays; `encode` gives new ones' ids.

    At most `limit` pieces are held: beyond that the cache starts afresh, so memory stays bounded."""

    def __init__(self, encode, limit: int = 300_000, bits: int = 20):
        self.encode, self.limit, self.mask = encode, limit, np.uint64((1 << bits) - 1)
        self.clear()

    def clear(self) -> None:
        size = int(self.mask) + 1
        self.slot = np.full(size, -1, np.int32)
        self.k1, self.k2, self.ln = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64), np.zeros(1024, np.int32)
        self.at, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids, self.n, self.n_ids = np.zeros(4096, np.uint32), 0, 0

    def find(self, k1, k2, ln) -> np.ndarray:
        out = np.full(len(k1), -1, np.int64)
        spot = self._spot(k1, k2, ln)
        todo = np.arange(len(k1))
        while len(todo):
            got = self.slot[spot[todo]]
            there = got >= 0
            todo, got = todo[there], got[there].astype(np.int64)
            same = (self.k1[got] == k1[todo]) & (self.k2[got] == k2[todo]) & (self.ln[got] == ln[todo])
            out[todo[same]] = got[same]
            todo = todo[~same]
            spot[todo] = (spot[todo] + np.uint64(1)) & self.mask
        return out

    def _spot(self, k1, k2, ln) -> np.ndarray:
        return mix64(k1 * np.uint64(0x9E3779B97F4A7C15) + mix64(k2 + ln.astype(np.uint64))) & self.mask

    def _add(self, k1, k2, ln, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Put in pieces that are not there and differ from each other; their numbers."""
        m, total = len(k1), int(count.sum())
        while self.n + m > len(self.k1):
            for name in ("k1", "k2", "ln", "at", "count"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        while self.n_ids + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        new = np.arange(self.n, self.n + m)
        self.k1[new], self.k2[new], self.ln[new], self.count[new] = k1, k2, ln, count
        self.at[new] = self.n_ids + bounds(count)[:-1]
        self.ids[self.n_ids:self.n_ids + total] = ids
        self.n, self.n_ids = self.n + m, self.n_ids + total
        spot, todo = self._spot(k1, k2, ln), np.arange(m)
        while len(todo):
            free = self.slot[spot[todo]] < 0
            _, one = np.unique(spot[todo[free]], return_index=True)
            put = todo[free][one]
            self.slot[spot[put]] = new[put]
            left = np.ones(m, bool)
            left[put] = False
            todo = todo[left[todo]]
            taken = self.slot[spot[todo]] >= 0
            spot[todo[taken]] = (spot[todo[taken]] + np.uint64(1)) & self.mask
        return new

    def lookup(self, buf, first, length) -> np.ndarray:
        """The number of each piece, after new ones have been encoded and put in."""
        if self.n > self.limit:
            self.clear()
        k1, k2 = piece_keys(buf, first, length)
        out = self.find(k1, k2, length)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            order = miss[np.lexsort((length[miss], k2[miss], k1[miss]))]
            new = np.ones(len(order), bool)
            new[1:] = ((k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1]) | (length[order][1:] != length[order][:-1]))
            one = order[new]
            while self.n + len(one) > 0.8 * len(self.slot):  # room for this batch whatever it holds
                self._grow()
            raw = buf.tobytes()
            ids, count = self.encode([raw[a:a + n] for a, n in zip(first[one].tolist(), length[one].tolist())])
            out[order] = self._add(k1[one], k2[one], length[one], ids, count)[np.cumsum(new) - 1]
        return out

    def _grow(self) -> None:
        self.mask = np.uint64((int(self.mask) + 1) * 2 - 1)
        self.slot = np.full(int(self.mask) + 1, -1, np.int32)
        n, spot = self.n, self._spot(self.k1[:self.n], self.k2[:self.n], self.ln[:self.n])
        todo = np.arange(n)
        while len(todo):
            free = self.slot[spot[todo]] < 0
            _, one = np.unique(spot[todo[free]], return_index=True)
            put = todo[free][one]
            self.slot[spot[put]] = put
            left = np.ones(n, bool)
            left[put] = False
            todo = todo[left[todo]]
            taken = self.slot[spot[todo]] >= 0
            spot[todo[taken]] = (spot[todo[taken]] + np.uint64(1)) & self.mask


def encode_texts(cache: PieceCache, classes: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts end to end, number of ids of each text)."""
    parts = [units(t) for t in texts]
    every = [u for p in parts for u in p]
    flat, per_unit = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for a, b in slices([len(u) for u in every]):
        buf, first, length, per = split(every[a:b], classes)
        which = cache.lookup(buf, first, length)
        n = cache.count[which].astype(np.int64)
        flat.append(cache.ids[ragged_index(cache.at[which], n)])
        per_unit.append(np.diff(bounds(n)[per]))
    return np.concatenate(flat), np.diff(bounds(np.concatenate(per_unit))[bounds([len(p) for p in parts])])
