"""Near-duplicate detection with BagMinHash over multisets of word shingles.

A text's shingles with their counts are weights; a count w is the interval (0, w], cut at the powers of two. Every
(shingle, interval) is a Poisson process: its points come in order of time, and each falls on a signature component
and on one unit of the interval; a point above the count does not exist for that text. The earliest point of each
component is the signature, and two texts agree in a component with exactly their weighted Jaccard similarity.
Signatures are banded, rows of a bucket are held against each other by their signatures, and the texts of what
that connects are verified by the overlap of their multisets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane.llm.common import bounds, map_column, materialise, mix64
from pitlane.llm.components import linked_rows, relabelled, undecided
from pitlane.llm.decontaminate import _WORD_BYTES
from pitlane.llm.pieces import piece_keys

WORDS = 5
SIMILARITY = 0.8
#: 32 bands of 4 components: texts of similarity 0.8 miss all of them with probability 5e-8.
BANDS, ROWS = 32, 4
COMPONENTS = BANDS * ROWS
#: Agreeing components from which a pair is verified: at similarity 0.8 fewer agree with probability 1e-9.
AGREE = 76
#: Rounds of bands: the first ones connect most of what is alike, so that later ones have little left to link.
BAND_ROUNDS = ((0, 1), (1, 4), (4, BANDS))
SIGNATURES_PER_BLOCK, TEXTS_PER_BLOCK = 1024, 128

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_PLACE = mix64(np.arange(101, 101 + WORDS, dtype=np.uint64) * GOLDEN) | np.uint64(1)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle of WORDS consecutive words: runs of ASCII letters (lower case), digits and other
    characters' bytes. A text of fewer words, but not none, has one shingle of all of them."""
    raw = [t.encode().translate(_WORD_BYTES) + b" " for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    inside = buf != 32
    edge = np.diff(np.concatenate([[0], inside.view(np.int8)]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    k1, k2 = piece_keys(buf, start, end - start)
    word = mix64(k1 * GOLDEN + mix64(k2 + (end - start).astype(np.uint64)))
    text_end = np.cumsum([len(r) for r in raw])
    of = np.searchsorted(text_end, start, "right")
    behind = np.searchsorted(of, np.arange(len(texts)), "right")[of]  # the word behind each word's text
    first = np.concatenate([[True], of[1:] != of[:-1]])
    i = np.flatnonzero((np.arange(len(word)) + WORDS <= behind) | first)
    padded = np.concatenate([word, np.zeros(WORDS, np.uint64)])
    total = np.zeros(len(i), np.uint64)
    for k in range(WORDS):
        total += np.where(i + k < behind[i], padded[i + k], np.uint64(0)) * _PLACE[k]
    return of[i], mix64(total)


def counted(of: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct shingles, in order of text and hash."""
    order = np.lexsort((shingle, of))
    of, shingle = of[order], shingle[order]
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (shingle[1:] != shingle[:-1])])) if len(of) else np.zeros(0, int)
    return of[new], shingle[new], np.diff(np.append(new, len(of)))


def signatures(n: int, of: np.ndarray, shingle: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature [text, component], which texts have one) of n texts from their counted shingles."""
    weight = np.bincount(of, count, n)
    # One row for each interval that a count reaches into: (0, 1], (1, 2], (2, 4], (4, 8], ...
    octaves = np.ceil(np.log2(count)).astype(np.int64) + 1
    row = np.repeat(np.arange(len(of)), octaves)
    octave = (np.arange(len(row)) - np.repeat(bounds(octaves)[:-1], octaves)).astype(np.uint64)
    length = np.uint64(1) << np.maximum(octave, np.uint64(1)) - np.uint64(1)
    seed, text, rate = mix64(shingle[row] + mix64(octave + np.uint64(7))), of[row], length * float(COMPONENTS)
    above = count[row].astype(np.uint64) - np.where(octave == 0, np.uint64(0), length)  # units of the interval below the count
    best, which = np.full(n * COMPONENTS, np.inf), np.zeros(n * COMPONENTS, np.uint64)
    limit = (np.log(COMPONENTS) + 2.5) / np.maximum(weight, 1)
    rows = np.arange(len(row))
    while len(rows):
        # All points up to the limit, every process's next one at a time.
        cols = [x[rows] for x in (seed, text, rate, length, above)] + [limit[text[rows]], np.zeros(len(rows))]
        number = 0
        while len(cols[0]):
            draw = mix64(cols[0] + np.uint64(number * int(GOLDEN) % 2**64))
            cols[6] -= np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / cols[2]
            live = cols[6] <= cols[5]
            live = np.flatnonzero(live)
            draw, cols = draw[live], [c[live] for c in cols]
            mark = mix64(draw ^ np.uint64(0x51ED2701C1A3D5B7))
            there = (mark >> np.uint64(16)) % cols[3] < cols[4] if len(draw) and cols[3].max() > 1 else slice(None)
            slot = (cols[1] * COMPONENTS + (mark & np.uint64(COMPONENTS - 1)).astype(np.int64))[there]
            time = cols[6][there]
            np.minimum.at(best, slot, time)
            won = time == best[slot]
            which[slot[won]] = draw[there][won]
            number += 1
        # Texts with a component that no point has reached yet: once more, further on.
        short = np.isinf(best).reshape(n, COMPONENTS).any(1) & (weight > 0)
        limit[short] *= 2
        rows = np.flatnonzero(short[text]) if short.any() else rows[:0]
    return which.reshape(n, COMPONENTS), weight > 0


def _signature_columns(texts: list[str]) -> list[pa.Array]:
    """For each text its signature in 16 bits a component and the hash of each band; nulls without words."""
    of, shingle = shingles(texts)
    sig, there = signatures(len(texts), *counted(of, shingle))
    band = np.zeros((len(texts), BANDS), np.uint64)
    for k in range(ROWS):
        band = mix64(band * GOLDEN + sig[:, k::ROWS])
    band = mix64(band + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
    short = sig.astype(np.uint16)
    return [pa.array([short[i].tobytes() if there[i] else None for i in range(len(texts))], pa.binary()),
            pa.array([band[i] if there[i] else None for i in range(len(texts))], pa.list_(pa.int64()))]


def _by_signature(rows: pa.Table):
    sig = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.uint16).reshape(-1, COMPONENTS)
    return lambda k, others: (sig[others] == sig[k]).sum(1) >= AGREE


def _by_overlap(rows: pa.Table):
    """Exact similarity: the c-th occurrence of a shingle is an element of its own, so that overlaps of multisets are
    overlaps of sets; a row's elements are marked, and the marks of all other rows' elements summed up."""
    of, shingle, count = counted(*shingles(rows.column("x").to_pylist()))
    repeat = np.arange(int(count.sum())) - np.repeat(bounds(count)[:-1], count)
    element = np.repeat(shingle, count) + mix64(repeat.astype(np.uint64)) * (repeat > 0).astype(np.uint64)
    _, element = np.unique(element, return_inverse=True)
    size = np.bincount(np.repeat(of, count), minlength=rows.num_rows)
    at = bounds(size)
    mark = np.zeros(int(element.max(initial=-1)) + 1, bool)

    def linked(k: int, others: np.ndarray) -> np.ndarray:
        mine = element[at[k]:at[k + 1]]
        mark[mine] = True
        sums = bounds(mark[element])
        shared = sums[at[others + 1]] - sums[at[others]]
        mark[mine] = False
        return shared >= SIMILARITY * (size[k] + size[others] - shared)

    return linked


def text_key(column: str = "text"):
    return F.md5(F.col(column).cast("binary"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text_key, class_id, class_key) of every distinct text of docs: class_id is the smallest key of all documents in
    its class, class_key a text key that stands for the class.

    Texts are of one class if they are equal or linked, over any number of links, by a weighted Jaccard similarity of
    SIMILARITY or more of their multisets of shingles. Null texts are not in the result: each such document is alone.
    Texts without words (empty ones too) are only equal to themselves. Repeated rows are equal texts. Null keys
    come last in class_id, which is null only if all are. Further columns are not read; an empty table gives none.

    Equal texts are one row from the first aggregation on, whose map side combines a hot text's copies. A bucket's
    rows meet in blocks of bounded size, as signatures; only links between components that are not connected yet
    leave a task, and the texts of each connected group then meet in bounded blocks again. Buckets of the same
    members count once. No bucket or group is capped."""
    body = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("text"))
    signed = map_column(body.select("k", "text", text_key().alias("text_key")), ["k", "text_key"], "text", lambda: _signature_columns,
                        [("sig", T.BinaryType()), ("bands", T.ArrayType(T.LongType()))])
    distinct = signed.groupBy("text_key").agg(F.min("k").alias("first_key"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    distinct = materialise(distinct.withColumn("tid", F.monotonically_increasing_id()), "signed-texts")
    # Buckets with two members or more; of those with the same members, one. From the second round
    # on only buckets with members of different components are looked at.
    label = distinct.select("tid", F.col("tid").alias("c"))
    for first, behind in BAND_ROUNDS:
        band = distinct.select("tid", F.explode(F.slice("bands", first + 1, behind - first)).alias("bucket"))
        filled = (band.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("tid")).alias("x"), F.bit_xor(F.xxhash64("tid", F.lit(1))).alias("y"))
                  .where("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")))
        members = undecided(band.join(filled.select("bucket", "n"), "bucket").join(label, "tid"), "bucket", "c")
        members = materialise(members, "buckets")
        two = members.where("n = 2").groupBy("bucket").agg(F.min("c").alias("a"), F.max("c").alias("b")).select("a", "b")
        more = members.where("n > 2").join(distinct.select("tid", "sig"), "tid")
        links = two.unionByName(linked_rows(more, "bucket", "n", "tid", "c", SIGNATURES_PER_BLOCK, _by_signature, "sig"))
        label = relabelled(label, "c", links)
    # The texts of likely groups, one row a text, and the links that hold: first inside blocks and between
    # neighbours, then between all blocks of the groups that this has not connected.
    likely = label.withColumnRenamed("c", "likely")
    sizes = likely.groupBy("likely").agg(F.count("*").alias("n")).where("n > 1")
    wanted = likely.join(sizes, "likely").join(distinct.select("tid", "text_key"), "tid")
    texts = body.select(text_key().alias("text_key"), "text").join(wanted, "text_key").dropDuplicates(["text_key"])
    texts = materialise(texts.select("tid", "likely", "n", "text"), "likely-texts")
    label = distinct.select("tid", F.col("tid").alias("c"))
    for far in (False, True):
        rows = texts.join(label, "tid")
        if far:
            rows = undecided(rows.where(F.col("n") > TEXTS_PER_BLOCK), "likely", "c")
        label = relabelled(label, "c", linked_rows(rows, "likely", "n", "tid", "c", TEXTS_PER_BLOCK, _by_overlap, "text", far))
    roots = distinct.join(label, "tid").select("text_key", "first_key", F.col("c").alias("root"))
    classes_ = roots.groupBy("root").agg(F.min("first_key").alias("class_id"), F.min(F.struct(F.col("first_key").isNull(), "first_key", "text_key")).alias("least"))
    return roots.join(classes_.select("root", "class_id", F.col("least.text_key").alias("class_key")), "root").select("text_key", "class_id", "class_key")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id) of every row of docs: the smallest key of its near-duplicate class (see classes); a document
    with a null text has its own key."""
    known = classes(docs, key, text).select("text_key", "class_id")
    rows = docs.select(F.col(key).alias("k"), F.when(F.col(text).isNotNull(), text_key(text)).alias("text_key"))
    found = rows.where("text_key is not null").join(known, "text_key").select("k", "class_id")
    alone = rows.where("text_key is null").select("k", F.col("k").alias("class_id"))
    return found.unionByName(alone).select(F.col("k").alias(key), "class_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay if of each class of near duplicates one does: the smallest key of the class (null
    keys last), of equal keys the smallest text key, of repeated rows one. Rows with a null text all stay."""
    id_ = F.coalesce(F.col(key).cast("string"), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(row.alias("kept"), text_key(text).alias("text_key"), id_.alias("id"), F.col(key).isNull().alias("none"), F.col(text).isNull().alias("no_text"))
    stays = classes(docs, key, text).where("text_key = class_key").select("text_key", F.coalesce(F.col("class_id").cast("string"), F.lit("")).alias("id"), F.col("class_id").isNull().alias("none"))
    left = rows.where("not no_text").join(stays, ["text_key", "id", "none"]).groupBy("text_key", "id", "none").agg(F.first("kept").alias("kept"))
    return left.select("kept.*").unionByName(docs.where(F.col(text).isNull()))
