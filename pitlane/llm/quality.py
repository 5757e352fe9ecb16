"""Quality scores by compression: a text that good texts' dictionary shortens more than bad texts' is a good one.

Two zstandard dictionaries are trained, one on labelled good and one on labelled bad texts. Every whole text is
compressed block by block under both; the difference of the compressed sizes by the text's own size goes through a
logistic calibration that is fitted on labelled texts the dictionaries have not seen, weighted to the classes' true
shares. Nothing else of a text enters its score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane.llm.common import map_column

#: Bytes that are compressed at a time and bytes of a dictionary; the level of compression.
BLOCK, DICTIONARY_BYTES, LEVEL = 300, 110_000, 12


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries' bytes (none: the score is the constant), calibration weights and the difference's scale."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    constant: float


def blocks(text: bytes) -> list[bytes]:
    return [text[i:i + BLOCK] for i in range(0, max(len(text), 1), BLOCK)]


def dictionary(texts: list[str]) -> bytes:
    """A dictionary of the texts; where they are too few to train one, their own bytes."""
    parts = [b for t in texts for b in blocks(t.encode())]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY_BYTES:]


class Difference:
    """How much smaller whole texts get under the good texts' dictionary than under the bad ones', by their own size."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False,
                                              write_content_size=False, write_dict_id=False) for d in (good, bad)]

    def __call__(self, texts: list[str]) -> np.ndarray:
        rows = np.empty((len(texts), 3))
        for i, t in enumerate(texts):
            raw = t.encode()
            rows[i] = *(sum(len(c.compress(b)) for b in blocks(raw)) for c in self.pair), len(raw)
        good, bad, size = rows.T
        return ((bad - good) / np.maximum(size, 1))[:, None]


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights, the intercept last, of a logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (w * (p - y)) + penalty @ b)
        b = b - step
        if np.abs(step).max() < 1e-9:
            break
    return b


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the key's text has remainder 2 by 4 (a null key: no text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = 2000, max_bytes: int = 16_384, key: str = "doc_id",
        text: str = "text", label: str = "quality") -> CompressionModel:
    """Learn from labelled rows outside the held-out fold.

    Bound of the sample that comes to the driver: rows_per_class keys of each class, the first in the order of
    their hash, with a text of max_bytes at most (so 64 MB at the defaults, however large the tables). Keys with
    two different labels, null keys, null labels and labels other than 0 and 1 are left out; repeated rows count
    once. Without rows of both classes the score is a constant: the share of label 1, smoothed."""
    k = F.col(key)
    known = (labels.where(k.isNotNull() & F.col(label).isin(0, 1) & ~held_out(k)).groupBy(k)
             .agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("y2")).where("y = y2").select(k.alias("k"), "y"))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("k"), F.col("k")]
    chosen = F.broadcast(known.where("y = 1").orderBy(*order).limit(rows_per_class)
                         .unionByName(known.where("y = 0").orderBy(*order).limit(rows_per_class)))
    rows = (docs.where(F.octet_length(text) <= max_bytes).select(k.alias("k"), F.col(text).alias("body")).join(chosen, "k")
            .groupBy("k", "y").agg(F.min("body").alias("body")).orderBy(*order).collect())
    by = {y: [r["body"] for r in rows if r["y"] == y] for y in (0, 1)}
    share = (total.get(1, 0) + 0.5) / (sum(total.values()) + 1)
    if not by[0] or not by[1]:
        return CompressionModel(b"", b"", (), (), (), share)
    # Every second row makes the dictionaries, the others calibrate.
    seen, rest = ({y: t[i::2] or t for y, t in by.items()} for i in (0, 1))
    good, bad = dictionary(seen[1]), dictionary(seen[0])
    x = Difference(good, bad)(rest[1] + rest[0])
    y = np.array([1.0] * len(rest[1]) + [0.0] * len(rest[0]))
    w = np.where(y == 1, total[1] / len(rest[1]), total[0] / len(rest[0]))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    b = fit_logistic((x - mean) / scale, y, w * len(y) / w.sum())
    return CompressionModel(good, bad, tuple(b), tuple(mean), tuple(scale), share)


def score(docs: DataFrame, model: CompressionModel, key: str | list[str] = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row of docs: how likely label 1 is, 0 to 1. Only the text is looked at, all of it. Null
    texts count as empty and are scored too; rows are handled one by one, so repeated rows and further columns make
    no difference; an empty table gives none."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value
        difference = Difference(m.good, m.bad) if m.weights else None

        def work(texts: list[str]) -> list[pa.Array]:
            if difference is None:
                return [pa.array(np.full(len(texts), m.constant))]
            x = (difference(texts) - np.array(m.mean)) / np.array(m.scale)
            z = np.column_stack([x, np.ones(len(x))]) @ np.array(m.weights)
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))]

        return work

    return map_column(docs, key, text, make, [("score", T.DoubleType())])


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))
