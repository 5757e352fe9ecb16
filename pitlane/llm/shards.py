"""Sharding by rendezvous hashing: a record goes to the shard that draws best for the record's key.

Every (key, shard) pair draws a number from its hash, scaled by the shard's weight; the lowest draw wins. The key
and the set of shards alone decide, so a further shard takes only the records that it wins and no other moves.
Slots number a shard's records from 0 in order of the key: a range partitioning sorts the thin rows, a running
count numbers them inside each partition, and prefix sums over (partition, shard) counts give the bases.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane.llm.common import materialise, partitions_for

#: Rows of (partition, shard) bases up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
ROWS_BYTES = 64  # a thin row while it is sorted
BYTES_PER_PARTITION = 128 << 20


def draw(key: Column, shard: int, weight: float) -> Column:
    """The draw of a shard for keys (their text; null counts as empty): an exponential of the shard's weight."""
    h = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"#{shard}"))), 1, 13), 16, 10)
    return -F.log((h.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def best(key: Column, weights: list[float]) -> Column:
    """struct(draw, shard) of the shard that wins each key; equal draws go to the smaller number."""
    each = [F.struct(draw(key, i, w).alias("draw"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.least(*each) if len(each) > 1 else each[0]


def assign(docs: DataFrame, weights: list[float], new_weight: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) of every row of docs.

    size: UTF-8 bytes of the text (null: none) plus 16. shard: 0 .. len(weights) - 1, in proportion to the weights.
    slot: 0, 1, ... in each shard in order of key (null keys first, rows of one key in any order). grown_shard: the
    shard if one more of new_weight is added. Null keys all draw as an empty key. Repeated rows go to the same
    shard with slots of their own; one key may hold any share of the rows, as a row number takes part in dealing
    rows to tasks. Further columns are not read. An empty table gives none."""
    if not weights or min([*weights, new_weight]) <= 0:
        raise ValueError("weights must be positive")
    spark, k = docs.sparkSession, F.col(key)
    body = F.coalesce(F.col(text), F.lit(""))
    thin = docs.select(k.alias("k"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
                       F.monotonically_increasing_id().alias("row"))
    n = partitions_for(spark, docs.count() * ROWS_BYTES, BYTES_PER_PARTITION)
    # Drawn behind the exchange: what lies before it is computed twice, once for the sample that sets the ranges.
    drawn = (thin.repartitionByRange(n, F.col("k").asc_nulls_first(), F.col("row")).sortWithinPartitions(F.col("k").asc_nulls_first())
             .select("k", "size", "text_crc32", best(F.col("k"), weights).alias("won"), draw(F.col("k"), len(weights), new_weight).alias("new")))
    dealt = drawn.select("k", "size", "text_crc32", F.col("won.shard").alias("shard"),
                         F.when(F.col("new") < F.col("won.draw"), len(weights)).otherwise(F.col("won.shard")).alias("grown_shard"))
    schema = T.StructType([*dealt.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType())])

    def number(batches):
        seen, part = np.zeros(len(weights), np.int64), TaskContext.get().partitionId()
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            seq = pd.Series(shard).groupby(shard).cumcount().to_numpy() + seen[shard]
            seen += np.bincount(shard, minlength=len(seen))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(shard), part, np.int32)), pa.array(seq)], schema.names)

    # The partition of a row and its number there are fixed by being written, whatever is run again later.
    numbered = materialise(dealt.mapInArrow(number, schema), "shards")
    count = numbered.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = count.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if n * len(weights) <= BROADCAST_ROWS:
        base = F.broadcast(base)
    return numbered.join(base, ["part", "shard"]).select(
        F.col("k").alias(key), "size", "text_crc32", "shard", (F.col("base") + F.col("seq")).alias("slot"), "grown_shard")

