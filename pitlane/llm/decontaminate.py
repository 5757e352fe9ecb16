"""Benchmark decontamination with a generalised suffix automaton over the words of all test items.

A document's words run through the automaton one by one; it keeps the longest run of words, ending here, that
some item holds. Where that run is as long as a window, the state of its last window's words tells the items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane.llm.common import SLICE_BYTES, slices

#: Words that one automaton is made of at most (about 100 MB); further items go to further automata.
WORDS_PER_AUTOMATON = 100_000

_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Letters A to Z become lower case; all bytes but letters, digits and those of other characters become spaces.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """The normalised words of a text as UTF-8."""
    return text.encode().translate(_WORD_BYTES).split()


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and the byte behind the last of each word of a UTF-8 text."""
    inside = np.frombuffer(text.translate(_WORD_BYTES), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class ItemAutomaton:
    """Generalised suffix automaton of the items' words, with the items of each window."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words(text)]) for name, text in items]
        coded = [(name, ids) for name, ids in coded if ids]
        for _, ids in coded:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        # Items by the state whose words hold one of their windows: whole windows, and the short items by length.
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        self.least = min((min(len(ids), window) for _, ids in coded), default=window)
        for name, ids in coded:
            state = 0
            for k, w in enumerate(ids):
                state = self.next[state][w]
                if k + 1 >= window:
                    self.full.setdefault(self._window_state(state), set()).add(name)
            if len(ids) < window:
                self.short.setdefault(state, []).append((len(ids), name))

    def _extend(self, last: int, w: int) -> int:
        """Add a word behind the words of state last; the state of the longer words."""
        there = self.next[last].get(w)
        if there is not None:
            return there if self.len[there] == self.len[last] + 1 else self._clone(last, w, there)
        new = self._state(self.len[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, length: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.len.append(length)
        self.link.append(0)
        return len(self.len) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.len[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _window_state(self, state: int) -> int:
        """The state that the last window's words of a state lead to."""
        while self.len[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, codes: list[int], shift: int) -> Iterator[tuple[int, int, str]]:
        """(first word, word behind the last, item) of each window among consecutive known words."""
        state = length = 0
        follow, link, size, window = self.next, self.link, self.len, self.window
        for i, w in enumerate(codes):
            while state and w not in follow[state]:
                state = link[state]
                length = size[state]
            if w in follow[state]:
                state = follow[state][w]
                length += 1
            if length >= window:
                for name in self.full[self._window_state(state)]:
                    yield shift + i + 1 - window, shift + i + 1, name
            if length >= self.least and self.short:
                at = state
                while at > 0:
                    for n, name in self.short.get(at, ()):
                        if n <= length:
                            yield shift + i + 1 - n, shift + i + 1, name
                    at = link[at]

    def hits(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(words of the text, word ranges inside windows, items that they are of)."""
        all_words = words(text)
        if not self.vocab or not all_words:
            return len(all_words), [], set()
        get = self.vocab.get
        codes = np.fromiter((get(w, -1) for w in all_words), np.int64, len(all_words))
        edge = np.diff(np.concatenate([[0], (codes >= 0).view(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - start >= self.least
        ranges, items = [], set()
        for a, b in zip(start[long].tolist(), end[long].tolist()):
            for x, y, name in self.scan(codes[a:b].tolist(), a):
                ranges.append((x, y))
                items.add(name)
        return len(all_words), merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges as disjoint ones in order; touching ranges become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def automata(items: DataFrame, window: int, item_id: str, text: str) -> Iterator[ItemAutomaton]:
    """Automata of all items; each is made of rows that come to the driver one part after the other, and no more
    of them than WORDS_PER_AUTOMATON allows (one item at least)."""
    held, size = [], 0
    for name, body in items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(
            F.col(item_id).cast("string"), text).toLocalIterator():
        n = len(words(body))
        if held and size + n > WORDS_PER_AUTOMATON:
            yield ItemAutomaton(held, window)
            held, size = [], 0
        held.append((name, body))
        size += n
    yield ItemAutomaton(held, window)


def find_items(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id",
               item_text: str = "text", keep: Column | None = None) -> DataFrame:
    """(kept, text, n_words, hits, items) of every row of docs: its words, the disjoint word ranges [first, behind
    last) that lie inside an occurrence of a window (flat: first, behind, first, ...), and the ids of the items whose
    windows occur, sorted as strings. kept is the column `keep` (default: the whole row as a struct), handed through.

    A window is `window` consecutive words of an item, or all words of a shorter one. Null texts have no words and
    no hits; items whose id or text is null, or that have no word, have no window; repeated items count once. An
    empty table on either side gives no hits. Further columns and their names do not matter."""
    spark = docs.sparkSession
    keep = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if keep is None else keep
    out = docs.select(keep.alias("kept"), F.col(text).alias("text"), F.lit(0).cast("long").alias("n_words"),
                      F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))
    for automaton in automata(items, window, item_id, item_text):
        sent = spark.sparkContext.broadcast(automaton)
        out = out.mapInArrow(_scan(sent), out.schema)
    return out


def _scan(sent):
    def run(batches):
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_pylist()
            for a, b in slices(sizes, SLICE_BYTES):
                part = batch.slice(a, b - a)
                n_words, hits, items = [], [], []
                for body, old, known in zip(*(part.column(c).to_pylist() for c in ("text", "hits", "items"))):
                    n, ranges, found = sent.value.hits(body or "")
                    if old:
                        ranges = merged([*ranges, *zip(old[::2], old[1::2])])
                    n_words.append(n)
                    hits.append([x for r in ranges for x in r])
                    items.append(sorted(found.union(known)))
                yield pa.RecordBatch.from_arrays([
                    part.column("kept"), part.column("text"), pa.array(n_words, pa.int64()),
                    pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], batch.schema.names)

    return run


def covered(hits: str = "hits") -> Column:
    """How many words the ranges of a column of hits cover."""
    return F.aggregate(F.transform(hits, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x)


def report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = find_items(docs, items, window, keep=F.col("doc_id"))
    return found.select(F.col("kept").alias("doc_id"), "n_words", covered().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


@F.pandas_udf(T.StringType())
def cut_words(texts: pd.Series, hits: pd.Series) -> pd.Series:
    """Texts without the characters from the first to the last word of each range of hits."""
    out = []
    for text, found in zip(texts, hits):
        if text is not None and len(found):
            raw = text.encode()
            start, end = word_spans(raw)
            at = [0, *(x for a, b in zip(found[::2], found[1::2]) for x in (int(start[a]), int(end[b - 1]))), len(raw)]
            text = b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2])).decode()
        out.append(text)
    return pd.Series(out, dtype=object)
