"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a pre-token there is exactly one token that can end its encoding. It is the longest token
that ends there and whose neighbour on the left (the stored last token of the prefix before it) may stand
beside it, where two tokens may stand beside each other if merging their joined bytes gives exactly the two.
The table of last tokens makes appends exact (it is only extended) and lets an edit re-encode nothing but the
pre-tokens near it.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane.llm import libraries
from pitlane.llm.common import bounds, map_column, ragged_index
from pitlane.llm.pieces import PieceCache, encode_texts, split


class PrefixBPE:
    """Tables of one rank vocabulary: tokens[k] has rank and id k; every single byte must be a token."""

    def __init__(self, tokens: list[bytes], classes: np.ndarray):
        self.tokens, self.classes = tokens, classes
        self.rank = {t: i for i, t in enumerate(tokens)}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("every single byte must be a token")
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.joined: dict[tuple[int, int], int] = {}
        self.size = [len(t) for t in tokens]
        self.longest = max(self.size)
        self.made: dict[bytes, int] = {}  # the tokens that merging their own bytes makes
        for i, t in enumerate(tokens):
            if len(t) == 1:
                self.made[t] = i
            elif (halves := self._halves(t, i)) is not None:
                self.left[i], self.right[i] = halves
                self.joined[halves] = i
                self.made[t] = i
        self.beside: dict[int, bool] = {}  # of pairs as one number; bounded below

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of this token joins; None if merging its bytes never makes it."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            r, at = min((self.rank.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if r >= rank:
                return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return self.rank[parts[0]], self.rank[parts[1]]

    def _may_stand(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together gives a, b. Undo the merges on either side of the seam from
        the latest on: a pair across the seam that was there to be merged earlier would have been taken."""
        limit = len(self.tokens)
        left, right = self.left, self.right
        while True:
            if self.joined.get((a, b), limit) < limit:
                return False
            if a > b or left[b] == b:
                if left[a] == a:
                    if left[b] == b:
                        return True
                    limit, b = b + 1, left[b]
                else:
                    limit, a = a, right[a]
            else:
                limit, b = b + 1, left[b]

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of each prefix of a pre-token. known: the table of a prefix of it, to be extended."""
        last = list(known or ())
        made, beside = self.made, self.beside
        for end in range(len(last) + 1, len(piece) + 1):
            for start in range(max(0, end - self.longest), end):
                token = made.get(piece[start:end])
                if token is None:
                    continue
                if start:
                    pair = last[start - 1] << 32 | token
                    ok = beside.get(pair)
                    if ok is None:
                        if len(beside) >= 200_000:
                            beside.clear()
                        ok = beside[pair] = self._may_stand(last[start - 1], token)
                    if not ok:
                        continue
                last.append(token)
                break
        return last

    def ids(self, piece: bytes, last: list[int]) -> list[int]:
        """The encoding of a pre-token from its table; a pre-token that is itself a token is that token."""
        if (whole := self.rank.get(piece)) is not None:
            return [whole]
        out, end = [], len(piece)
        while end > 0:
            out.append(last[end - 1])
            end -= self.size[out[-1]]
        return out[::-1]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        each = [self.ids(p, self.last_tokens(p)) if p not in self.rank else [self.rank[p]] for p in pieces]
        return np.array([i for ids in each for i in ids], np.uint32), np.array([len(x) for x in each], np.int64)


class EditableEncoding:
    """The encoding of one text, kept under appends and edits. Only the pre-tokens that an edit can reach are split
    and encoded again, and of the first of them only the bytes after the edit's place."""

    def __init__(self, bpe: PrefixBPE, text: str = ""):
        self.bpe, self.text, self.pieces = bpe, "", []
        self.replace(0, 0, text)

    def _pieces(self, text: str) -> list[str]:
        buf, first, length, _ = split([text], self.bpe.classes)
        raw = buf.tobytes()
        return [raw[a:a + n].decode() for a, n in zip(first.tolist(), length.tolist())]

    def ids(self) -> list[int]:
        return [i for p, last in self.pieces for i in self.bpe.ids(p.encode(), last)]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Put new in place of text[start:end]; the number of pre-tokens that were encoded again."""
        keep = at = 0
        while keep < len(self.pieces) and at + len(self.pieces[keep][0]) + 2 <= start:
            at += len(self.pieces[keep][0])
            keep += 1
        cut = re.compile(r"(?<=\S)\s").search(self.text, end + 1)
        stop = cut.start() if cut else len(self.text)
        tail, behind = len(self.pieces), len(self.text)
        while behind > stop:
            tail -= 1
            behind -= len(self.pieces[tail][0])
        again = []
        for k, piece in enumerate(self._pieces(self.text[at:start] + new + self.text[end:stop])):
            known = None
            if k == 0 and keep < len(self.pieces):
                old, last = self.pieces[keep]
                a, b = old.encode(), piece.encode()
                same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                known = last[:same]
            again.append((piece, self.bpe.last_tokens(piece.encode(), known)))
        self.pieces[keep:tail] = again
        self.text = self.text[:start] + new + self.text[end:]
        return len(again)


@lru_cache(maxsize=2)
def _worker(tokens: bytes, sizes: bytes, classes: bytes) -> tuple[PrefixBPE, PieceCache]:
    at = bounds(np.frombuffer(sizes, np.int32)).tolist()
    bpe = PrefixBPE([tokens[a:b] for a, b in zip(at, at[1:])], np.frombuffer(classes, np.uint8))
    return bpe, PieceCache(bpe.encode_pieces)


def packed_ranks(path: str, pattern: str) -> tuple[bytes, bytes, bytes]:
    """A rank file and its pattern engine's character classes in the form that is broadcast (about 2 MB)."""
    tokens = libraries.read_ranks(path)
    sizes = np.array([len(t) for t in tokens], np.int32)
    return b"".join(tokens), sizes.tobytes(), libraries.rank_classes(pattern).tobytes()


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids) of every row of docs, ids as tiktoken's encode_ordinary gives them for the ranks at path.

    Null texts count as empty: no ids. Rows are handled one by one, so repeated rows, null keys and further
    columns (which are not read) make no difference; an empty table gives none. A long text is worked through in
    parts that end where no pre-token can cross."""
    packed = docs.sparkSession.sparkContext.broadcast(packed_ranks(path, pattern))

    def make():
        bpe, cache = _worker(*packed.value)

        def work(texts: list[str]) -> list[pa.Array]:
            ids, count = encode_texts(cache, bpe.classes, texts)
            return [pa.array(count), pa.ListArray.from_arrays(pa.array(bounds(count), pa.int32()), pa.array(ids.astype(np.int32)))]

        work.release = _worker.cache_clear
        return work

    return map_column(docs, key, text, make, [("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType()))])


def joined_rows(rows: list[bytes]):
    """A function from ids to (all their rows' bytes end to end, first byte of each id's row and the end)."""
    flat, size = np.frombuffer(b"".join(rows), np.uint8), np.array([len(r) for r in rows], np.int64)
    start = bounds(size)[:-1]

    def take(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = size[ids]
        return flat[ragged_index(start[ids], n)], bounds(n)

    return take


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, n_tokens, decoded, ids_text) of every row: how many ids it has, the bytes that they stand for, and the
    ids in decimal joined by one space. Null or empty ids give empty bytes; a null or unknown id inside raises."""
    tokens = encoded.sparkSession.sparkContext.broadcast(libraries.read_ranks(path))

    def make():
        decode = decoder(tokens.value)

        def work(rows: list) -> list[pa.Array]:
            return decode(np.concatenate([np.zeros(0, np.int64), *(np.asarray(r, np.int64) for r in rows)]), np.array([len(r) for r in rows], np.int64))

        return work

    return map_column(encoded, key, ids, make, DECODED)


DECODED = [("n_tokens", T.LongType()), ("decoded", T.BinaryType()), ("ids_text", T.StringType())]


def decoder(tokens: list[bytes]):
    """A function from the ids of rows end to end and their numbers to the columns of DECODED."""
    take_bytes, take_digits = joined_rows(tokens), joined_rows([b"%d " % i for i in range(len(tokens))])

    def decode(flat: np.ndarray, count: np.ndarray) -> list[pa.Array]:
        at = bounds(count)
        raw, raw_at = take_bytes(flat)
        digits, digits_at = take_digits(flat)
        raw, raw_at = raw.tobytes(), raw_at[at].tolist()
        digits, digits_at = digits.tobytes(), digits_at[at].tolist()
        return [pa.array(count),
                pa.array([raw[a:b] for a, b in zip(raw_at, raw_at[1:])], pa.binary()),
                pa.array([digits[a:max(a, b - 1)].decode() for a, b in zip(digits_at, digits_at[1:])], pa.string())]

    return decode


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What decode_documents gives of encode_documents' ids, in one pass over the texts (see both for odd rows)."""
    packed = docs.sparkSession.sparkContext.broadcast(packed_ranks(path, pattern))

    def make():
        bpe, cache = _worker(*packed.value)
        decode = decoder(bpe.tokens)

        def work(texts: list[str]) -> list[pa.Array]:
            ids, count = encode_texts(cache, bpe.classes, texts)
            return decode(ids.astype(np.int64), count)

        work.release = _worker.cache_clear  # a worker that goes on with other work holds no tables for this one
        return work

    return map_column(docs, key, text, make, DECODED)


def digests(decoded: DataFrame, key: str = "doc_id", decoded_text: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of decoded documents, and the decoded text if asked for."""
    text = [F.col("decoded").cast("string").alias("text")] if decoded_text else []
    return decoded.select(key, "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"), *text)


def encoded_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: encoded, and decoded from the ids."""
    return digests(round_trip(docs, path, pattern))
