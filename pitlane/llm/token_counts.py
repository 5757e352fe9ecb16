"""Token counts of whole texts by rank-synchronous merging.

The distinct pre-tokens of a batch lie end to end in one array of symbols. Every round gives each adjacent pair
its rank, takes each sequence's lowest, and merges all places of that pair in all sequences at once; sequences
without a pair left retire with the number of symbols they still have.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pitlane.llm import libraries
from pitlane.llm.common import bounds, map_column
from pitlane.llm.pieces import PieceCache, encode_texts

NO_RANK = np.iinfo(np.int64).max


class ArrayMerger:
    """Merge tables as sorted arrays: pair key -> (rank, id of the joined symbol)."""

    def __init__(self, byte_id: np.ndarray, pair: np.ndarray, rank: np.ndarray, joined: np.ndarray):
        order = np.argsort(pair)
        self.byte_id, self.pair, self.rank, self.joined = byte_id, pair[order], rank[order], joined[order]

    def symbols(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(surviving symbols of all pieces end to end, their number in each piece)."""
        size = np.array([len(p) for p in pieces], np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        live = np.arange(len(pieces))  # the piece of each sequence still at work
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            start = bounds(size)[:-1]
            rank, to = self._ranks(sym, start + size - 1)
            low = np.minimum.reduceat(rank, start)
            hit = (rank == np.repeat(low, size)) & (rank != NO_RANK)
            # Of a run of touching places (a symbol repeated) every second one merges, from the left.
            first = hit & ~np.concatenate([[False], hit[:-1]])
            at = np.arange(len(hit))
            hit &= (at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0
            sym = np.where(hit, to, sym)
            keep = ~np.concatenate([[False], hit[:-1]])
            size = np.add.reduceat(keep.astype(np.int64), start)
            sym = sym[keep]
            over = low == NO_RANK
            if over.any():
                gone = np.repeat(over, size)
                done.append((live[over], size[over], sym[gone]))
                sym, live, size = sym[~gone], live[~over], size[~over]
        return self._in_order(done, len(pieces))

    def _ranks(self, sym: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.empty(len(sym), np.int64)
        key[:-1] = (sym[:-1] << 32) | sym[1:]
        key[last] = -1
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        there = self.pair[at] == key
        return np.where(there, self.rank[at], NO_RANK), self.joined[at]

    @staticmethod
    def _in_order(done: list, n: int) -> tuple[np.ndarray, np.ndarray]:
        count = np.zeros(n, np.int64)
        for who, size, _ in done:
            count[who] = size
        out, start = np.zeros(int(count.sum()), np.uint32), bounds(count)[:-1]
        for who, size, sym in done:
            out[np.repeat(start[who] - bounds(size)[:-1], size) + np.arange(len(sym))] = sym
        return out, count


def merger_arrays(path: str) -> tuple[np.ndarray, ...]:
    """The arrays of a .json vocabulary's merges. A symbol must be made before it is merged further, so that all
    places of a sequence's lowest pair can be merged at once; that is checked here."""
    tokens, merges, _ = libraries.read_json_bpe(path)
    made = {joined: rank for rank, joined in merges.values()}
    for (a, b), (rank, _) in merges.items():
        if max(made.get(a, -1), made.get(b, -1)) >= rank:
            raise ValueError(f"{path}: a merge comes before one that it needs")
    one = {t: i for i, t in enumerate(tokens) if len(t) == 1}
    rows = np.array([((a << 32) | b, rank, joined) for (a, b), (rank, joined) in merges.items()], np.int64)
    return np.array([one[bytes([b])] for b in range(256)], np.int64), rows[:, 0], rows[:, 1], rows[:, 2]


@lru_cache(maxsize=2)
def _worker(*arrays: bytes) -> PieceCache:
    merger = ArrayMerger(*(np.frombuffer(a, np.int64) for a in arrays))

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        _, count = merger.symbols(pieces)
        return count.astype(np.uint32), np.ones(len(count), np.int64)  # the cache holds one number a piece: its count

    return PieceCache(encode)


def count_tokens(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row of docs: UTF-8 bytes, tokens as the tokenizers library counts
    them for the byte-level file at path, and whether they are more than limit. Special strings inside a text are
    one token each, as is the library's default.

    Null texts count as empty (0 bytes, 0 tokens). Rows are handled one by one: repeated rows, null keys and further
    columns make no difference, an empty table gives none, long texts are worked through in parts."""
    arrays = [a.tobytes() for a in merger_arrays(path)]
    special = sorted(libraries.read_json_bpe(path)[2])
    sent = docs.sparkSession.sparkContext.broadcast((arrays, libraries.json_classes()))

    def make():
        cache, classes = _worker(*sent.value[0]), sent.value[1]

        def work(texts: list[str]) -> list[pa.Array]:
            parts = [libraries.split_special(t, special) for t in texts]
            per_part, one = encode_texts(cache, classes, [s for p in parts for s in p[0]])
            at = bounds(one)
            sums = np.diff(bounds(per_part)[at[bounds([len(p[0]) for p in parts])]])
            n = sums + np.array([len(p[1]) for p in parts], np.int64)
            return [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)]

        return work

    return map_column(docs, key, text, make, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())])
