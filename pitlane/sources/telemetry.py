"""Telemetry sources (S02, S03, K13 helper) and the adapter over the shared events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane import schemas as S
from pitlane.session import path_exists
from pitlane.sources.laps import _numeric_nan_to_null

try:  # MLlib vectors count as non-scalar when present
    from pyspark.ml.linalg import VectorUDT
except Exception:  # pragma: no cover
    VectorUDT = None


def read_telemetry_csv(spark: SparkSession, path: str | None) -> DataFrame:
    """Optional telemetry CSV; a missing file gives an empty frame with the schema."""
    if path is None or not path_exists(spark, path):
        return spark.createDataFrame([], S.TELEMETRY)
    raw = spark.read.schema(S.TELEMETRY_CSV).option("header", True).csv(path)
    return _numeric_nan_to_null(raw.select([F.col(h).alias(n) for h, n, _ in S.TELEMETRY_COLUMNS]))


def telemetry_from_testdata(spark: SparkSession, sf_dir: str, with_time: bool = False) -> DataFrame:
    """Telemetry rows derived from the events table (FIXTURES.md section 2.2).

    with_time=True also keeps the sample id and time (event_id, ts) for live-style consumers.
    """
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    u10 = F.col("user_id") % 10
    u20 = F.col("user_id") % 20
    return ev.select(
        F.when(u10 == 1, F.lit("Red Bull Racing")).otherwise(F.concat(F.lit("Team "), u10.cast("string"))).alias("team"),
        F.when(u20 == 1, F.lit("VER")).otherwise(F.concat(F.lit("D"), u20.cast("string"))).alias("driver"),
        (F.col("event_id") % 60 + 1).cast("int").alias("lap_number"),
        (F.lit(180.0) + F.col("value")).alias("speed_fl"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("double"))
         .otherwise(F.lit(200.0) + F.col("value") / 2.0).alias("speed_st"),
        *([F.col("event_id").alias("sample_id"), F.col("ts")] if with_time else []),
    )


TELEMETRY_SQL = """
telemetry AS (
  SELECT
    CASE WHEN user_id % 10 = 1 THEN 'Red Bull Racing' ELSE 'Team ' || CAST(user_id % 10 AS VARCHAR) END AS team,
    CASE WHEN user_id % 20 = 1 THEN 'VER' ELSE 'D' || CAST(user_id % 20 AS VARCHAR) END AS driver,
    CAST(event_id % 60 + 1 AS INTEGER) AS lap_number,
    180e0 + value AS speed_fl,
    CASE WHEN event_type = 'error' THEN NULL ELSE 200e0 + value / 2e0 END AS speed_st,
    event_id AS sample_id, ts
  FROM events
)"""


def _is_scalar(dt: T.DataType) -> bool:
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return False
    if VectorUDT is not None and isinstance(dt, VectorUDT):
        return False
    if isinstance(dt, T.UserDefinedType):
        return False
    return True


def scalar_columns(df: DataFrame) -> DataFrame:
    """Keep only columns whose type is scalar. Decided from the schema; no data pass."""
    keep = [f.name for f in df.schema.fields if _is_scalar(f.dataType)]
    return df.select(*[F.col(f"`{c}`") for c in keep])
