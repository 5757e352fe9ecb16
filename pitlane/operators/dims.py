"""Global scalars and small dimensions.

Global statistics (one row, one value) are attached as scalar subqueries:
Catalyst plans them as a partial aggregate + single-row exchange and merges
several subqueries over the same input into one job. Nothing is broadcast
whose size is not bounded.

Dimensions derived from the data (per-race medians, race codes, class counts)
are written as Parquet tables in the shared checkpoint folder, counted, and broadcast only
when the count is under a bound; above it the join stays a shuffle join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlane.session import scratch_path

# Rows a dimension may have and still be broadcast (a few MB at most for the
# narrow dimensions used here).
MAX_BROADCAST_ROWS = 200_000


def scalar(df: DataFrame, expr: Column) -> Column:
    """A one-value aggregate of `df` usable as a column anywhere (scalar subquery)."""
    return df.select(expr).scalar()


def materialize_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Write an intermediate result as a Parquet table in the shared checkpoint folder, read it back,
    and return it with its row count.

    One job computes and writes it (an RDD checkpoint would compute it twice);
    the count reads the written files only. The read-back cuts lineage,
    survives executor loss, and gives the planner the real file size.
    (DataFrame.observe is avoided on purpose: once a session has used it,
    fitted MLlib models that keep a training summary no longer serialise.)
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"dim-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    m = spark.read.parquet(path)
    return m, m.count()


def materialize(df: DataFrame) -> DataFrame:
    return materialize_counted(df)[0]


def checked_dim(dim: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Materialise a dimension; mark it for broadcast only when its row count is within the bound."""
    m, n = materialize_counted(dim)
    return F.broadcast(m) if n <= max_rows else m


def join_dim(fact: DataFrame, dim: DataFrame, on, how: str = "left",
             max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    return fact.join(checked_dim(dim, max_rows), on, how)
