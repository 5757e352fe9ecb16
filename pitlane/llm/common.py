"""Helpers shared by the corpus operators: table access, written intermediates, ragged arrays, byte tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane.session import scratch_path

#: Text bytes that one numpy pass inside a task works on; bounds a task's memory whatever the Arrow batch holds.
SLICE_BYTES = 1_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared checkpoint folder and read it back: lineage is cut, lost executors
    cost nothing before this point, and the shuffle files of the job that wrote it are dropped at once. batch_rows
    limits the rows that Python workers get at a time, for rows of large binaries."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    conf = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch_rows:
        conf["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch_rows)
    before = {key: spark.conf.get(key, None) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        df.write.mode("overwrite").parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, total_bytes: int, per_partition: int) -> int:
    """Shuffle partitions for that many bytes: the session's setting at least, more as the data grow."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total_bytes) // per_partition))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts (nulls count nothing)."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0])


def slices(sizes, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each (one row at least)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Flat positions of the ranges [starts[i], starts[i] + lengths[i]), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, np.int64)
    ends = np.cumsum(lengths)
    step[0] = starts[0]
    step[ends[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)


def bounds(lengths) -> np.ndarray:
    """Start positions of consecutive ranges, and the end of the last."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an array of unsigned 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), np.uint64(base & (2**64 - 1)))
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def map_column(df: DataFrame, key: str | list[str], column: str, make, fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """The key columns and fields of every row. make() is called once a task and gives a function from a list of the
    column's values (nulls as empty) to one Arrow array a field; it gets rows of about SLICE_BYTES at a time. If the
    function has a `release`, that is called when the task ends."""
    keys = [key] if isinstance(key, str) else key
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(n, t) for n, t in fields)])
    listed = isinstance(df.schema[column].dataType, T.ArrayType)

    def run(batches):
        work = make()
        try:
            yield from columns(batches, work)
        finally:
            getattr(work, "release", lambda: None)()

    def columns(batches, work):
        for batch in batches:
            values = batch.column(len(keys))
            sizes = values.value_lengths() if listed else pa.compute.binary_length(values)
            for a, b in slices(pa.compute.fill_null(sizes, 0).to_pylist(), SLICE_BYTES // 4 if listed else SLICE_BYTES):
                part = values.slice(a, b - a)
                rows = [_list_row(x) for x in part] if listed else [x or "" for x in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keys))), *work(rows)], schema.names)

    return df.select(*(F.col(k) for k in keys), F.col(column)).mapInArrow(run, schema)


def _list_row(x: pa.ListScalar) -> np.ndarray:
    """The values of a list as an array; none for a null."""
    return x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int64)
