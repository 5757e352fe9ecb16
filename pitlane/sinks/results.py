"""Test-set results (K01), their head read (S05), the scalar export (K13) and document sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlane import constants as C
from pitlane.session import path_exists

RESULT_COLUMNS = ["real", "predicted", "laptime_s", "tyre_life", "position", "compound", "ers_status",
                  "superclipping_duration", "race", "lap", "race_progress"]


def results_projection(df: DataFrame, real: str, predicted: str) -> DataFrame:
    """The 11 result columns. Identifying columns ride along through scoring, so no lookup join."""
    return df.select(
        "row_key",
        F.col(real).alias("real"), F.col(predicted).alias("predicted"),
        F.col("lap_time_s").alias("laptime_s"), "tyre_life", "position", "compound", "ers_status",
        "superclipping_duration", F.coalesce(F.col("race"), F.lit("Unknown")).alias("race"),
        F.col("lap_number").alias("lap"), "race_progress")


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def results_head(df: DataFrame, n: int = C.RESULTS_HEAD, key: str = "row_key") -> DataFrame:
    """First n rows in an explicit order (files have no order); TakeOrderedAndProject."""
    return df.orderBy(key).limit(n)


def read_results_head(spark: SparkSession, path: str, schema: str, n: int = C.RESULTS_HEAD) -> DataFrame:
    return results_head(spark.read.schema(schema).option("header", True).csv(path), n)


def export_scalar_csv(df: DataFrame, path: str) -> dict:
    """Write scalar columns as CSV and report the row count (read back from the written files)."""
    from pitlane.sources.telemetry import scalar_columns

    out = scalar_columns(df)
    out.write.mode("overwrite").option("header", True).csv(path)
    rows = df.sparkSession.read.option("header", True).csv(path).count()
    return {"rows": rows, "columns": out.columns}


def write_json_document(spark: SparkSession, doc: dict, path: str) -> None:
    """Write one bounded document (metrics, provenance, dashboard) as a single JSON file.

    The document is already small (aggregates, at most a few hundred sample rows);
    it is written through Spark so the target can be any shared file system.
    """
    text = json.dumps(doc, ensure_ascii=False, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json_document(spark: SparkSession, path: str) -> dict | None:
    """Read a document written by write_json_document, or a plain JSON file; None when missing/broken."""
    if not path_exists(spark, path):
        return None
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except Exception:  # noqa: BLE001 -- a broken document disables only its own consumer
        return None
    for r in rows:
        try:
            return json.loads(r["value"])
        except (TypeError, ValueError):
            continue
    return None
