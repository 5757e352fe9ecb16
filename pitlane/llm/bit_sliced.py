"""Exact top-k search by inner product over a bit-sliced index.

Every attribute of a block of rows is stored as bitmaps, one for each binary digit of its quantised value above the
block's smallest. A query's scores of a whole block are a sum of those slices shifted by the set digits of the
query's own values, added up with bitwise carry-save and ripple-carry adders. The top rows come out of the sum's
slices from the most significant digit down: the rows known to be in, the rows still equal at the boundary; those
left equal at the end tie exactly and go in order of their ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlane.llm.common import materialise
from pitlane.llm.hard_negatives import HIGH, LOW, quantised, streamed

#: Rows of an index block, and queries of a part: what one task holds at a time.
ROWS_PER_BLOCK = 16_384
QUERIES_PER_PART = 256
#: Words of 64 rows that are added up at a time, so that the work stays in the processor's cache.
WORDS = 256
#: Quantised values below this in size are held as 64-bit numbers, others as whole numbers of any size.
MOST = 2.0**61


def to_bits(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, row 0 in the lowest bit."""
    flags = np.concatenate([flags, np.zeros((*flags.shape[:-1], -flags.shape[-1] % 64), bool)], axis=-1)
    return np.packbits(flags, axis=-1, bitorder="little").view("<u8")


def from_bits(words: np.ndarray) -> np.ndarray:
    """The rows whose bit is set."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


class BlockIndex:
    """The slices of one block: per attribute the smallest value and bitmaps [digit, word] of value - smallest."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, slices: list[np.ndarray]):
        self.ids, self.low, self.slices = ids, low, slices
        self.words = -(-len(ids) // 64)

    @classmethod
    def build(cls, ids: np.ndarray, values: np.ndarray) -> BlockIndex:
        """values: whole numbers held as doubles."""
        small = not values.size or np.abs(values).max() < MOST
        values = values.astype(np.int64) if small else np.array([[int(x) for x in row] for row in values], object)
        order = np.argsort(ids, kind="stable")
        values, low = values[order], values.min(0)
        above = (values - low).T
        digits = [max(1, int(a.max()).bit_length()) for a in above]
        return cls(ids[order], low, [to_bits((a >> np.arange(n)[:, None] & 1).astype(bool)) for a, n in zip(above, digits)])

    def scores(self, query: np.ndarray, at: slice) -> tuple[np.ndarray, int]:
        """(bitmaps [digit, word] of a number per row, what to add to it to get the row's inner product with query).

        A negative query value is handled by the complement of the attribute's digits, so all terms are added."""
        shift = 0
        terms: dict[int, list[np.ndarray]] = {}
        for q, low, bits in zip(map(int, query), self.low.tolist(), self.slices):
            bits, shift = bits[:, at], shift + q * low
            if q < 0:
                bits, shift = ~bits, shift + q * ((1 << len(bits)) - 1)
            for place in range(abs(q).bit_length()):
                if abs(q) >> place & 1:
                    terms.setdefault(place, []).append(bits)
        return total(terms, at.stop - at.start), shift


def total(terms: dict[int, list[np.ndarray]], words: int) -> np.ndarray:
    """Slices of the sum of numbers given as slices, each shifted by its place. Per place, three numbers become a sum
    and a carry as long as there are three; a ripple-carry addition adds up the two that are left."""
    out = np.zeros((0, words), np.uint64)
    for place in range(max(terms, default=-1), -1, -1):
        # Horner's scheme from the highest place: what is summed so far moves up one digit.
        out = np.concatenate([np.zeros((1, words), np.uint64), out]) if len(out) else out
        here = terms.get(place, ())
        if not here:
            continue
        depth = max(len(b) for b in here)
        stack = np.zeros((len(here), depth + len(here).bit_length(), words), np.uint64)
        for i, b in enumerate(here):
            stack[i, :len(b)] = b
        while len(stack) > 2:
            third = len(stack) // 3
            a, b, c = stack[:third], stack[third:2 * third], stack[2 * third:3 * third]
            either = a ^ b
            carried = np.zeros_like(a)
            carried[:, 1:] = ((a & b) | (c & either))[:, :-1]
            stack = np.concatenate([either ^ c, carried, stack[3 * third:]])
        added = stack[0] if len(stack) == 1 else ripple(stack[0], stack[1])
        out = ripple(out, added) if len(out) else added
    return out


def ripple(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Slices of the sum of two numbers given as slices."""
    n = max(len(a), len(b)) + 1
    out, carry = np.zeros((n, a.shape[1]), np.uint64), np.zeros(a.shape[1], np.uint64)
    none = np.zeros(a.shape[1], np.uint64)
    for i in range(n):
        x, y = a[i] if i < len(a) else none, b[i] if i < len(b) else none
        either = x ^ y
        out[i] = either ^ carry
        carry = (x & y) | (carry & either)
    while len(out) > 1 and not out[-1].any():
        out = out[:-1]
    return out


def top(slices: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """The rows (word bit numbers) of the k highest sums among the allowed ones, ties to the smaller number."""
    sure, equal = np.zeros_like(allowed), allowed
    if int(np.bitwise_count(allowed).sum()) <= k:
        return from_bits(allowed)
    for digit in slices[::-1]:
        higher = equal & digit
        n = int(np.bitwise_count(sure).sum()) + int(np.bitwise_count(higher).sum())
        if n > k:
            equal = higher
        else:
            sure = sure | higher
            equal = equal & ~digit
            if n == k:
                return from_bits(sure)
    rows = from_bits(sure)
    return np.concatenate([rows, from_bits(equal)[:k - len(rows)]])


def value_at(slices: np.ndarray, rows: np.ndarray) -> list[int]:
    """The sums of some rows, read off the slices."""
    bits = (slices[:, rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)
    return [sum(int(b) << i for i, b in enumerate(col)) for col in bits.T]


def best_of_block(index: BlockIndex, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(id, score) of the k best rows of a block for a query, without rows of the query's own id. Scores outside 64 bits
    are the nearest 64-bit number; where there could be such, all rows' sums are read off and ordered as these."""
    allowed = to_bits(index.ids != query_id)
    found: list[tuple[int, int]] = []
    for start in range(0, index.words, WORDS):
        at = slice(start, min(start + WORDS, index.words))
        sums, shift = index.scores(query, at)
        sums = sums if len(sums) else np.zeros((1, at.stop - at.start), np.uint64)
        rows = top(sums, allowed[at], k) if abs(shift) + (1 << len(sums)) <= HIGH else from_bits(allowed[at])
        found += zip(index.ids[rows + 64 * start].tolist(), [min(max(v + shift, LOW), HIGH) for v in value_at(sums, rows)])
    return sorted(found, key=lambda x: (-x[1], x[0]))[:k]


def taking_part(vectors: DataFrame, scale: int, key: str, vector: str) -> DataFrame:
    """(id, x, scale) of the rows that take part, components as double."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(finite)
    return rows.select(F.col(key).cast("long").alias("id"), x.alias("x"), F.lit(scale).alias("scale"))


#: Packed rows: a block of the index (ids, slices), or the queries of a part (aids, ids, vectors).
PACKED = "block long, dims int, aids binary, ids binary, vectors binary, low binary, digits binary, bits binary"


def packed(row: dict) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_pylist([row], pa.schema([(n, kinds[t]) for n, t in (c.split() for c in PACKED.split(", "))]))


def build_index(rows: DataFrame) -> DataFrame:
    """One row for each block of at most ROWS_PER_BLOCK rows with vectors of one length. Blocks are cut from the input
    partitions as they come, without a shuffle; the written table fixes them."""

    def run(batches):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, {}

        def block(dims: int) -> pa.RecordBatch:
            nonlocal number
            ids, values = zip(*held.pop(dims))
            index = BlockIndex.build(np.array(ids, np.int64), np.array(values, np.float64).reshape(len(ids), dims))
            number += 1
            return packed({"block": number, "dims": dims, "ids": index.ids.astype("<i8").tobytes(), "low": ",".join(map(str, index.low.tolist())).encode(),
                           "digits": np.array([len(s) for s in index.slices], "<u2").tobytes(), "bits": b"".join(s.tobytes() for s in index.slices)})

        for batch in batches:
            scale = batch.column("scale")[0].as_py() if len(batch) else 1
            for i, x in zip(batch.column("id").to_pylist(), quantised(batch.column("x"), scale)):
                mine = held.setdefault(len(x), [])
                mine.append((i, x))
                if len(mine) == ROWS_PER_BLOCK:
                    yield block(len(x))
        for dims in sorted(held):
            yield block(dims)

    return materialise(rows.mapInArrow(run, PACKED), "bit-slices")


def pack_queries(asked: DataFrame, parts: int) -> DataFrame:
    """One row (its number is the part) for the queries (aid, id, x, scale) of a part and one length."""

    def run(key, rows):
        vectors = [x for chunk in rows.column("x").chunks for x in quantised(chunk, rows.column("scale")[0].as_py())]
        return pa.Table.from_batches([packed({"block": key[0].as_py(), "dims": key[1].as_py(), "aids": rows.column("aid").to_numpy().astype("<i8").tobytes(),
                                              "ids": rows.column("id").to_numpy().astype("<i8").tobytes(), "vectors": np.array(vectors, "<f8").tobytes()})])

    dealt = asked.withColumn("part", F.pmod(F.xxhash64("aid"), F.lit(parts))).withColumn("dims", F.size("x"))
    return dealt.groupBy("part", "dims").applyInArrow(run, PACKED)


class Queries:
    def __init__(self, row: dict):
        self.aids, self.ids = (np.frombuffer(row[c], "<i8").tolist() for c in ("aids", "ids"))
        self.vectors = np.frombuffer(row["vectors"], "<f8").reshape(len(self.ids), row["dims"])


def opened(row: dict) -> BlockIndex | Queries:
    if row["bits"] is None:
        return Queries(row)
    ids = np.frombuffer(row["ids"], "<i8")
    digits, bits = np.frombuffer(row["digits"], "<u2"), np.frombuffer(row["bits"], "<u8").reshape(-1, -(-len(ids) // 64))
    at = np.concatenate([[0], np.cumsum(digits.astype(int))])
    low = np.array([int(x) for x in row["low"].decode().split(",") if x], object)
    return BlockIndex(ids, low, [bits[a:b] for a, b in zip(at, at[1:])])


def search(vectors: DataFrame, queries: DataFrame, k: int, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of vectors for each row of queries: highest inner product of
    the quantised vectors, ties to the smaller id, ranks from 1; all rows if fewer than k.

    Rows of the query's own id are no candidates. Rows with a null id, a null vector, or a null or non-finite
    component take no part, on either side. Vectors are compared with those of their length; empty ones score 0.
    Components may be of any size; scores outside 64 bits count as the nearest 64-bit number. A repeated candidate row
    counts as often as it is there; every row of a repeated query id asks for itself. Further columns are not read,
    empty tables give no rows.

    The query set meets all blocks of the index: tasks stream blocks past one part of the queries, and only the k best
    rows a query and stream come out."""
    spark = vectors.sparkSession
    index = build_index(taking_part(vectors, scale, key, vector))
    asked = materialise(taking_part(queries, scale, key, vector).withColumn("aid", F.monotonically_increasing_id()), "queries")
    parts = max(1, -(-asked.count() // QUERIES_PER_PART))
    lanes = max(1, min(index.count(), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // parts)))

    def visit(state, queries, block):
        for i, (query_id, query) in enumerate(zip(queries.ids, queries.vectors)):
            found = state.get(i, []) + best_of_block(block, query_id, query, k)
            state[i] = sorted(found, key=lambda x: (-x[1], x[0]))[:k]

    def finish(state, queries):
        rows = [(queries.aids[i], queries.ids[i], *f) for i, found in state.items() for f in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["aid", "query_id", "vec_id", "score"])

    found = streamed(index, pack_queries(asked, parts), parts, lanes, visit, finish, "aid long, query_id long, vec_id long, score long", "found", opened)
    rank = F.row_number().over(Window.partitionBy("aid").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
