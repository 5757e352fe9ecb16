"""Hard negatives by rotated one-bit codes: popcount estimates, Cauchy-Schwarz intervals, integer scores for the rest.

A vector is rotated and its signs are its code; the code as a unit vector, times the stored alignment (their inner
product), is the vector's nearest multiple of it, and what is left is rotated and coded again, STAGES times. A query's
inner product with the codes comes from popcounts against the bit planes of its own rotated, quantised values. The
residual is orthogonal to the last code, so by Cauchy and Schwarz it adds at most its length times the length of the
query without its part along that code, and quantising adds at most the alignment times the rounding's length: an
interval that always holds the true score. Rows whose interval cannot reach an anchor's best ones so far, or its wanted
range, are left out; the others are scored in whole numbers.

The index is cut into blocks without a shuffle; the anchors are packed into parts, and each task streams blocks past one
part, so the best ones found so far narrow the search as it goes. Nothing is grouped by label: a label that a third of
all rows have loads no task more than others.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlane.llm.common import materialise

#: Rows of an index block, and anchors of a part.
ROWS_PER_BLOCK, ANCHORS_PER_PART = 4096, 1024
#: One-bit codes a vector gets, each of what the ones before left over, and bit planes of a rotated query.
STAGES, PLANES = 4, 6
#: Scores outside 64 bits count as the nearest 64-bit number.
LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Packed rows that a worker gets at a time (some MB each).
BATCH_ROWS = 8

PACKED = "block long, dims int, aids binary, ids binary, labels binary, vectors binary, positives binary, codes binary, aligned binary, left binary, norms binary"


@lru_cache(maxsize=4)
def rotations(dims: int) -> list[np.ndarray]:
    """The fixed random rotations of STAGES codes, each from the frame of the one before."""
    rng = np.random.default_rng(20_011 + dims)
    return [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(STAGES)]


def words(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    pad = np.zeros((*flags.shape[:-1], -flags.shape[-1] % 64), bool)
    return np.packbits(np.concatenate([flags, pad], -1), axis=-1, bitorder="little").view("<u8")


class Codes:
    """Codes of a block's rows: per stage the sign bits and alignments; lengths of the residuals and of the rows."""

    def __init__(self, bits: np.ndarray, aligned: np.ndarray, left: np.ndarray, norms: np.ndarray):
        self.bits, self.aligned, self.left, self.norms = bits, aligned, left, norms

    @classmethod
    def of(cls, vectors: np.ndarray) -> Codes:
        n, dims = vectors.shape
        bits, aligned, rest = np.zeros((STAGES, n, -(-dims // 64)), "<u8"), np.zeros((STAGES, n)), vectors
        with np.errstate(over="ignore", invalid="ignore"):
            for stage, turn in enumerate(rotations(dims) if dims else ()):
                rest = rest @ turn.T
                sign = np.where(rest >= 0, 1.0, -1.0)
                bits[stage] = words(rest >= 0)
                aligned[stage] = np.abs(rest).sum(1) / np.sqrt(dims)
                rest = rest - aligned[stage][:, None] * sign / np.sqrt(dims)
            return cls(bits, aligned, np.sqrt((rest * rest).sum(1)), np.sqrt((vectors * vectors).sum(1)))

    def intervals(self, asked: Asked, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the rows' inner products with a query. Where lengths leave the range of doubles there
        are none, and the interval takes in everything."""
        n = len(range(*rows.indices(len(self.norms))))
        if not asked.dims:
            return np.zeros(n), np.zeros(n)
        estimate, wide, part = np.zeros(n), np.zeros(n), np.zeros(n)
        with np.errstate(over="ignore", invalid="ignore"):
            for stage in range(STAGES):
                bits, set_sum = self.bits[stage, rows], np.zeros(n)
                for place, plane in enumerate(asked.planes[stage]):
                    set_sum += np.bitwise_count(bits & plane).sum(1, dtype=np.int64) * float(1 << place)
                set_sum = asked.step[stage] * set_sum + asked.low[stage] * np.bitwise_count(bits).sum(1, dtype=np.int64)
                part = (2 * set_sum - asked.total[stage]) / np.sqrt(asked.dims)
                estimate += self.aligned[stage, rows] * part
                wide += self.aligned[stage, rows] * asked.rounding[stage]
            along = np.maximum(np.abs(part) - asked.rounding[-1], 0)
            wide += self.left[rows] * np.sqrt(np.maximum(asked.norm * asked.norm - along * along, 0))
            wide += 1e-9 * self.norms[rows] * asked.norm + 1e-6  # for the rounding of this arithmetic
            known = np.isfinite(estimate) & np.isfinite(wide)
            lower = np.where(known, estimate - wide, -np.inf)
            upper = np.where(known, estimate + wide, np.inf)
        return np.minimum(lower, float(HIGH)), np.maximum(upper, float(LOW))


class Asked:
    """A query, rotated into each stage's frame and quantised to PLANES bit planes."""

    def __init__(self, vector: np.ndarray):
        self.dims, self.norm = len(vector), float(np.sqrt((vector * vector).sum()))
        self.planes, self.low, self.step, self.total, self.rounding = [], [], [], [], []
        turned = vector
        with np.errstate(over="ignore", invalid="ignore"):
            for turn in rotations(self.dims) if self.dims else ():
                turned = turn @ turned
                low, high = float(turned.min()), float(turned.max())
                step = (high - low) / ((1 << PLANES) - 1) or 1.0
                if not np.isfinite(step):
                    low, step = 0.0, np.inf
                whole = np.rint((turned - low) / step) if np.isfinite(step) else np.zeros(self.dims)
                whole = np.clip(np.nan_to_num(whole), 0, (1 << PLANES) - 1).astype(np.int64)
                near = low + step * whole
                self.planes.append([words(whole >> p & 1 == 1) for p in range(PLANES)])
                self.low.append(low)
                self.step.append(step)
                self.total.append(float(near.sum()))
                self.rounding.append(float(np.sqrt(((turned - near) ** 2).sum())))


def whole_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of integers held as doubles, as 64-bit numbers."""
    if not vectors.size:
        return np.zeros(len(vectors), np.int64)
    if float(np.abs(vectors).max()) * float(np.abs(query).max()) * len(query) < 2.0**53:
        return (vectors @ query).astype(np.int64)  # no product or sum is rounded
    other = [int(x) for x in query]
    return np.array([min(max(sum(int(x) * y for x, y in zip(row, other)), LOW), HIGH) for row in vectors], np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, ~scores))[:k]  # ~ turns the order of all 64-bit numbers round
    return ids[order], scores[order]


class Found:
    """The k best rows so far in a range of scores."""

    def __init__(self, k: int, low: int = LOW, high: int = HIGH):
        self.k, self.low, self.high = k, low, high
        self.ids = self.scores = np.zeros(0, np.int64)

    def least(self, lower: np.ndarray, upper: np.ndarray) -> float:
        """What a row must reach: the range's low end, or the k-th best of those found, or of the rows at hand whose
        intervals lie inside the range, by what they are sure to have."""
        sure = lower[(lower >= self.low) & (upper <= self.high)]
        least = float(self.low)
        if len(self.scores) == self.k:
            least = max(least, float(self.scores[-1]))
        if len(sure) >= self.k:
            least = max(least, float(np.partition(sure, len(sure) - self.k)[len(sure) - self.k]))
        return least

    def may_take(self, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return (upper >= self.least(lower, upper)) & (lower <= float(self.high))

    def take(self, ids: np.ndarray, scores: np.ndarray) -> None:
        here = (scores >= self.low) & (scores <= self.high)
        if here.any():
            self.ids, self.scores = best(np.concatenate([self.ids, ids[here]]), np.concatenate([self.scores, scores[here]]), self.k)


def score_range(positive: int, low: int, high: int) -> tuple[int, int]:
    """The whole scores s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


# -- tables -----------------------------------------------------------------------------------------------------------

def taking_part(rows: DataFrame, scale: int, key: str, label: str, vector: str) -> DataFrame:
    """(id, label, x) of the rows that take part; x = floor(scale * component) as doubles, which hold it exactly."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    some = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()
    return rows.where(some).where(finite).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("x"), F.lit(scale).alias("scale"))


def packed_row(number: int, dims: int, aids, ids, labels, vectors: np.ndarray, positives: bytes, with_codes: bool) -> dict:
    """Rows as one row of binaries. Index rows are in order of their labels."""
    codes = Codes.of(vectors) if with_codes else None
    single = vectors.astype("<f4")
    exact = bool((single.astype("<f8") == vectors).all())
    out = {"block": number, "dims": dims, "aids": aids.astype("<i8").tobytes(), "ids": ids.astype("<i8").tobytes(), "labels": labels.astype("<i8").tobytes(),
           "vectors": (b"f" + single.tobytes()) if exact else (b"d" + vectors.astype("<f8").tobytes()), "positives": positives}
    if codes is None:
        return out | dict.fromkeys(("codes", "aligned", "left", "norms"))
    return out | {"codes": codes.bits.tobytes(), "aligned": codes.aligned.tobytes(), "left": codes.left.tobytes(), "norms": codes.norms.tobytes()}


class Packed:
    """A packed row, opened."""

    def __init__(self, row: dict):
        self.aids, self.ids, self.labels = (np.frombuffer(row[c], "<i8") for c in ("aids", "ids", "labels"))
        n, self.dims = len(self.ids), row["dims"]
        self.vectors = np.frombuffer(row["vectors"][1:], "<f4" if row["vectors"][:1] == b"f" else "<f8").astype(np.float64).reshape(n, self.dims)
        self.positives = np.frombuffer(row["positives"], "<i8").reshape(-1, 3)
        if row["codes"] is not None:
            self.codes = Codes(np.frombuffer(row["codes"], "<u8").reshape(STAGES, n, -(-self.dims // 64)), np.frombuffer(row["aligned"]).reshape(STAGES, n),
                               np.frombuffer(row["left"]), np.frombuffer(row["norms"]))


def quantised(lists: pa.Array, scale: int) -> list[np.ndarray]:
    return [np.floor(scale * x.values.to_numpy(zero_copy_only=False)) for x in lists]


def arrow(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(n, kinds[t]) for n, t in (c.split() for c in PACKED.split(", "))]))


def build_index(rows: DataFrame) -> DataFrame:
    """One packed row for each block of at most ROWS_PER_BLOCK rows with vectors of one length, written. Blocks are cut from
    the input's partitions as they come."""

    def run(batches):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, {}

        def block(dims: int) -> pa.RecordBatch:
            nonlocal number
            ids, labels, vectors = zip(*held.pop(dims))
            ids, labels = np.array(ids, np.int64), np.array(labels, np.int64)
            order, number = np.lexsort((ids, labels)), number + 1
            ids, labels, vectors = ids[order], labels[order], np.array(vectors, np.float64).reshape(len(ids), dims)[order]
            return arrow([packed_row(number, dims, ids, ids, labels, vectors, b"", True)])

        for batch in batches:
            scale = batch.column("scale")[0].as_py() if len(batch) else 1
            for i, label, x in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), quantised(batch.column("x"), scale)):
                mine = held.setdefault(len(x), [])
                mine.append((i, label, x))
                if len(mine) == ROWS_PER_BLOCK:
                    yield block(len(x))
        for dims in sorted(held):
            yield block(dims)

    return materialise(rows.mapInArrow(run, PACKED), "code-index")


def pack_anchors(anchors: DataFrame, parts: int) -> DataFrame:
    """One packed row (its number is the part) for the anchors of a part and one length; anchors (aid, id, label, x, scale,
    positives) with their positives as rows (aid, id, score)."""

    def run(key, rows):
        vectors = [x for chunk in rows.column("x").chunks for x in quantised(chunk, rows.column("scale")[0].as_py())]
        aids, ids, labels = (rows.column(c).to_numpy() for c in ("aid", "id", "label"))
        positives = [(a, p["id"], p["score"]) for a, many in zip(aids.tolist(), rows.column("positives").to_pylist()) for p in many or ()]
        dims = key[1].as_py()
        row = packed_row(key[0].as_py(), dims, aids, ids, labels, np.array(vectors).reshape(len(ids), dims), np.array(positives, "<i8").tobytes(), False)
        return pa.Table.from_batches([arrow([row])])

    dealt = anchors.withColumn("part", F.pmod(F.xxhash64("aid"), F.lit(parts))).withColumn("dims", F.size("x"))
    return dealt.groupBy("part", "dims").applyInArrow(run, PACKED)


def streamed(index: DataFrame, packed: DataFrame, parts: int, lanes: int, visit, finish, schema: str, name: str, opened=Packed) -> DataFrame:
    """visit(state, anchors, block) for every part of the anchors and every block of the index, and finish(state, anchors)
    for a part's results, written. Each pair of part and lane is a stream of its own: first its anchors, then its blocks.
    index and packed have the same columns; opened makes anchors and blocks of their rows."""
    head = packed.withColumn("kind", F.lit(0)).withColumn("part", F.col("block")).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    body = (index.withColumn("kind", F.lit(1)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
            .withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int")))
    both = head.unionByName(body).repartition(parts * lanes, "part", "lane").sortWithinPartitions("part", "lane", "kind")

    def run(batches):
        key, open_ = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if (row["part"], row["lane"]) != key:
                    for anchors, state in open_.values():
                        yield from finish(state, anchors)
                    key, open_ = (row["part"], row["lane"]), {}
                if row["kind"] == 0:
                    open_[row["dims"]] = opened(row), {}
                elif row["dims"] in open_:
                    visit(open_[row["dims"]][1], open_[row["dims"]][0], opened(row))
        for anchors, state in open_.values():
            yield from finish(state, anchors)

    return materialise(both.mapInArrow(run, schema), name, BATCH_ROWS)


def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def asked_once(state: dict, i: int, vector: np.ndarray) -> Asked:
    if ("asked", i) not in state:
        state["asked", i] = Asked(vector)
    return state["asked", i]


def nearest_of_label(index: DataFrame, packed: DataFrame, parts: int, lanes: int, k: int) -> DataFrame:
    """(aid, rank, vec_id, score): each anchor's k best other rows of its label."""

    def visit(state, anchors, block):
        for i in range(len(anchors.ids)):
            a, b = np.searchsorted(block.labels, [anchors.labels[i], anchors.labels[i] + 1]).tolist()
            if a == b:
                continue
            found = state.setdefault(i, Found(k))
            query = anchors.vectors[i]
            lower, upper = block.codes.intervals(asked_once(state, i, query), slice(a, b))
            other = block.ids[a:b] != anchors.ids[i]
            lower, upper = np.where(other, lower, -np.inf), np.where(other, upper, -np.inf)
            rows = a + np.flatnonzero(found.may_take(lower, upper) & other)
            found.take(block.ids[rows], whole_scores(block.vectors[rows], query))

    def finish(state, anchors):
        for i, found in state.items():
            if isinstance(i, int) and len(found.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found.ids), anchors.aids[i])), pa.array(found.ids), pa.array(found.scores)], ["aid", "vec_id", "score"])

    found = streamed(index, packed, parts, lanes, visit, finish, "aid long, vec_id long, score long", "positives")
    return ranked(found, ["aid"], k)


def in_ranges(index: DataFrame, packed: DataFrame, parts: int, lanes: int, k: int, low: int, high: int) -> DataFrame:
    """(aid, place, vec_id, score, rank): for each anchor and place among its positives the k best rows of other labels whose
    score is between low and high hundredths of the positive's."""

    def visit(state, anchors, block):
        if "places" not in state:
            places: dict[int, list[Found]] = {}
            for aid, _, score in anchors.positives.tolist():
                places.setdefault(aid, []).append(Found(k, *score_range(score, low, high)))
            state["places"] = [[f for f in places.get(a, ())] for a in anchors.aids.tolist()]
        for i, wanted in enumerate(state["places"]):
            if not any(f.low <= f.high for f in wanted):
                continue
            query = anchors.vectors[i]
            lower, upper = block.codes.intervals(asked_once(state, i, query), slice(None))
            other = (block.labels != anchors.labels[i]) & (block.ids != anchors.ids[i])
            lower, upper = np.where(other, lower, -np.inf), np.where(other, upper, -np.inf)
            may = np.zeros(len(other), bool)
            for f in wanted:
                may |= f.may_take(lower, upper)
            rows = np.flatnonzero(may & other)
            scores = whole_scores(block.vectors[rows], query)
            for f in wanted:
                f.take(block.ids[rows], scores)

    def finish(state, anchors):
        for i, wanted in enumerate(state.get("places", ())):
            for place, f in enumerate(wanted):
                if len(f.ids):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f.ids), anchors.aids[i])), pa.array(np.full(len(f.ids), place, np.int32)),
                                                      pa.array(f.ids), pa.array(f.scores)], ["aid", "place", "vec_id", "score"])

    found = streamed(index, packed, parts, lanes, visit, finish, "aid long, place int, vec_id long, score long", "negatives")
    return ranked(found, ["aid", "place"], k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
         key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (a row for which is_anchor
    holds) and each of its best rows of the same label, the best rows of other labels whose score, in hundredths of the
    positive's, is between low and high; ranks from 1. Scores are inner products of floor(scale * component), ties go to
    the smaller id; fewer rows if there are fewer.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Empty vectors do, with score 0.
    Vectors meet those of their length. Scores outside 64 bits count as the nearest 64-bit number. Rows of the anchor's own id
    are neither its positives nor its negatives; every anchor row of a repeated id asks for itself, and a repeated candidate
    counts as often as it is there. A positive of score 0 has negatives of score 0, one below 0 none. Further columns are not
    read. Empty tables give no rows."""
    spark = vectors.sparkSession
    index = build_index(taking_part(vectors, scale, key, label, vector))
    asked = taking_part(vectors.where(is_anchor), scale, key, label, vector)
    asked = materialise(asked.withColumn("aid", F.monotonically_increasing_id()), "anchors")
    parts = max(1, -(-asked.count() // ANCHORS_PER_PART))
    lanes = max(1, min(index.count(), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // parts)))
    none = F.expr("cast(array() as array<struct<id:bigint,score:bigint>>)")
    near = materialise(nearest_of_label(index, pack_anchors(asked.withColumn("positives", none), parts), parts, lanes, positives), "nearest")
    lists = near.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("positives"))
    again = asked.join(lists, "aid").withColumn("positives", F.expr("transform(positives, p -> struct(p.id, p.score))"))
    found = in_ranges(index, pack_anchors(again, parts), parts, lanes, negatives, low, high)
    each = near.select("aid", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(each, ["aid", "place"]).join(asked.select("aid", F.col("id").alias("anchor_id")), "aid").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
