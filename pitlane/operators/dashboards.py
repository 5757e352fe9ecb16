"""Dashboard aggregates and the dashboard document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlane import constants as C
from pitlane.functions.numeric import round_even, trunc_int
from pitlane.operators.sampling import hash_sample


def status_levels(spark) -> DataFrame:
    """The three ordered status levels as a literal dimension (3 rows)."""
    return spark.createDataFrame([(i, s) for i, s in enumerate(C.STATUS_LEVELS)], "level_order int, ers_status string")


def ers_distribution(df: DataFrame) -> DataFrame:
    """Rows per status including levels with no rows; missing status excluded."""
    counts = df.filter(F.col("ers_status").isNotNull()).groupBy("ers_status").agg(F.count(F.lit(1)).alias("n"))
    levels = F.broadcast(status_levels(df.sparkSession))  # 3 literal rows
    return (levels.join(counts, "ers_status", "left")
            .select("ers_status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "level_order"))


def avg_duration_by_compound(df: DataFrame) -> DataFrame:
    """Mean superclipping duration per compound, 2 decimals (half-even on the binary value)."""
    return df.groupBy("compound").agg(round_even(F.avg("superclipping_duration"), 2).alias("avg_duration"))


def avg_risk_by_lap(df: DataFrame) -> DataFrame:
    """A10: mean ERS risk per lap number, 2 decimals."""
    return df.groupBy("lap_number").agg(round_even(F.avg("ers_risk"), 2).alias("avg_risk"))


def dashboard_sample(df: DataFrame, n: int = C.DASHBOARD_SAMPLE, seed: int = 42) -> DataFrame:
    """T04 + F25: reproducible sample of min(n, rows) rows, formatted for the dashboard.

    The n smallest seeded hashes of the row key (`hash_sample`: their threshold by
    counting passes, then a map-side filter).
    """
    picked = hash_sample(df, n, seed)
    return picked.select(
        "row_key",
        trunc_int("lap_number").alias("lap"),
        round_even("lap_time_s", 3).alias("laptime_s"),
        trunc_int("tyre_life").alias("tyre_life"),
        trunc_int("position").alias("position"),
        "compound",
        round_even("ers_risk", 2).alias("ers_risk"),
        F.coalesce(F.col("ers_status"), F.lit("nan")).alias("ers_status"),
        round_even("superclipping_duration", 2).alias("superclipping_duration"),
        round_even("race_progress", 3).alias("race_progress"),
        round_even("lap_time_delta", 3).alias("lap_delta"),
    )


def dashboard_document(df: DataFrame, n: int = C.DASHBOARD_SAMPLE) -> dict:
    """The bounded dashboard document (<= n sample rows plus three small aggregates).

    Only bounded results reach the driver: the sample is capped at n rows and the
    aggregates have one row per status / compound / lap number.
    """
    sample = [r.asDict() for r in dashboard_sample(df, n).drop("row_key").orderBy("lap").collect()]
    dist = {r["ers_status"]: r["n"] for r in ers_distribution(df).orderBy("level_order").collect()}
    by_comp = {r["compound"]: r["avg_duration"] for r in avg_duration_by_compound(df).collect()}
    by_lap = {str(r["lap_number"]): r["avg_risk"] for r in avg_risk_by_lap(df).orderBy("lap_number").collect()}
    return {
        "telemetry_history": sample,
        "ers_distribution": dist,
        "avg_superclipping_by_compound": by_comp,
        "avg_ers_risk_by_lap": by_lap,
    }
