"""Structured Streaming over arriving lap files.

R01 scores every arriving lap with the three trained models and appends the
rows to the history tables inside foreachBatch. Each micro-batch writes into
the partition of its run and batch with dynamic partition overwrite; row ids are
md5(row key) and the batch's time is that of its first attempt, so a replayed
batch (after a failure, from the checkpoint) replaces its own output instead of
duplicating it.

R02 is the live lap feed: row-local duration and status per arriving row, and the
ordered feed, whose state is one consolidated row per lap (first non-null values in
row-key order), kept by a streaming aggregation and published as versions of laps, so
that files in any order, late ones and restarts give what a batch over all rows gives.
R03 keeps the
dashboard aggregates up to date (complete output mode; the risk bounds are the
fixed ones saved with the training run, because a global min/max is not a
streaming quantity).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pitlane import schemas as S
from pitlane.functions import lookup, risk
from pitlane.operators import dashboards as DB
from pitlane.operators.feed import first_per_lap
from pitlane.plans.scoring import ScoringContext, critical_alerts, score_clusters, score_risk_class, score_safety
from pitlane.sinks import history as H


def lap_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Lap files (Parquet with the internal lap schema) as a stream."""
    r = spark.readStream.schema(S.LAPS)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def score_batch(ctx: ScoringContext, batch: DataFrame, batch_id: int, history_base: str, run_id: str = "default") -> list[str]:
    """R01 micro-batch: the model scores, alerts, predictions and lap rows appended to the history tables. A model
    that is not loaded disables its own rows only; the names of the scorers that ran are returned."""
    spark = batch.sparkSession
    H.init_tables(spark, history_base)
    ts, key = H.batch_time(spark, history_base, run_id, batch_id), F.col("row_key")

    def put(rows: DataFrame, table: str) -> None:
        H.append(H.history_rows(rows, table, key, ts), history_base, table, batch_id, run_id)

    ran = []
    if ctx.tree_model is not None:
        put(score_risk_class(ctx, batch).drop("color"), "classification_results")
        ran.append("risk_class")
    if ctx.clusters is not None:
        put(score_clusters(ctx, batch), "cluster_assignments")
        ran.append("clusters")
    if ctx.safety is not None:
        saf = score_safety(ctx, batch)
        put(saf, "safety_events")
        put(critical_alerts(saf), "alert_history")
        ran.append("safety")
    H.append(H.lap_prediction_rows(batch, ts), history_base, "superclipping_predictions", batch_id, run_id)
    H.append(H.telemetry_rows(batch, ts), history_base, "telemetry_data", batch_id, run_id)
    return ran


def start_scoring(ctx: ScoringContext, source: DataFrame, history_base: str, checkpoint: str,
                  available_now: bool = False, processing_time: str | None = None, run_id: str | None = None) -> StreamingQuery:
    """Start the scoring stream (foreachBatch sink, checkpointed). A stream's rows are kept apart from others' by
    its run id; by default that follows from the checkpoint folder, which is what a restarted stream shares."""
    name = run_id or "stream-" + hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    w = (source.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: score_batch(ctx, df, bid, history_base, name)))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def live_feed(source: DataFrame) -> DataFrame:
    """Row-local duration and status on every arriving lap (stateless, append mode)."""
    d = source.withColumn("superclipping_duration", risk.live_duration())
    return d.select("row_key", "driver", "race", "year", "lap_number", "position", "compound",
                    "superclipping_duration", risk.live_status("superclipping_duration").alias("ers_status"))


FEED_KEYS = ["race", "year", "driver", "lap_number"]
FEED_COLUMNS = ["position", "compound", "tyre_life", "lap_time_s", "normalized_tyre_life", "race_progress", "lap_time_delta"]


def lap_state(source: DataFrame) -> DataFrame:
    """The consolidated laps of a stream (update mode): per race, year, driver and lap the first non-null value of each
    column in row-key order. Rows are combined before the shuffle, so a hot driver or lap costs a row a task; what arrives
    twice or in another order changes nothing."""
    return first_per_lap(source, keys=FEED_KEYS, order=("row_key",), columns=FEED_COLUMNS)


def start_ordered_feed(source: DataFrame, base: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Publish the laps that a micro-batch has changed as a version of their own. A replayed batch replaces its version."""
    def publish(laps: DataFrame, batch_id: int) -> None:
        out = laps.withColumn("version", F.lit(int(batch_id)).cast("bigint"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(f"{base}/laps")

    w = lap_state(source).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(publish)
    return (w.trigger(availableNow=True) if available_now else w).start()


def current_laps(spark: SparkSession, base: str, since: int | None = None) -> DataFrame:
    """The newest version of every lap; since: only laps that versions after this one have changed."""
    rows = spark.read.parquet(f"{base}/laps")
    rows = rows if since is None else rows.where(F.col("version") > since)
    newest = F.max_by(F.struct(*FEED_COLUMNS), "version").alias("lap")
    return rows.groupBy(*FEED_KEYS).agg(newest, F.max("version").alias("version")).select(*FEED_KEYS, "lap.*", "version")


def ordered_feed(laps: DataFrame) -> DataFrame:
    """W02 over every driver of every race: cursor index, total, last flag and the payload, from consolidated laps. A window
    holds one driver's laps of one race."""
    d = laps.withColumn("superclipping_duration", risk.live_duration()).withColumn("ers_status", risk.live_status("superclipping_duration"))
    group = Window.partitionBy("race", "year", "driver")
    index = F.row_number().over(group.orderBy("lap_number")) - 1
    total = F.count(F.lit(1)).over(group)
    return d.select("race", "year", "driver", index.alias("lap_index"), F.col("lap_number").cast("int").alias("lap_number"), total.alias("total_laps"),
                    F.coalesce(F.col("position").cast("int"), F.lit(1)).alias("position"), F.coalesce(F.col("compound"), F.lit("MEDIUM")).alias("compound"),
                    "ers_status", "superclipping_duration", (index + 1 == total).alias("is_last"))


def dashboard_stream(source: DataFrame, bounds: tuple[float, float]) -> dict[str, DataFrame]:
    """Incremental A08-A10 with fixed risk bounds; run each with outputMode('complete')."""
    lo, hi = bounds
    scored = (source.withColumn("ers_risk", risk.ers_scaled(risk.ers_raw(), F.lit(lo), F.lit(hi)))
              .withColumn("ers_status", risk.ers_status("ers_risk"))
              .withColumn("superclipping_duration", risk.superclip_duration("ers_risk"))
              .withColumn("compound_encoded", lookup.compound_code()))
    return {
        "ers_distribution": scored.filter(F.col("ers_status").isNotNull()).groupBy("ers_status")
                                  .agg(F.count(F.lit(1)).alias("n")),
        "avg_duration_by_compound": DB.avg_duration_by_compound(scored),
        "avg_risk_by_lap": DB.avg_risk_by_lap(scored),
    }


def write_lap_files(laps: DataFrame, path: str, files: int = 4) -> None:
    """Stage lap rows as Parquet files for a file-source stream (tests, backfills)."""
    laps.select(*[f.name for f in S.LAPS.fields]).repartition(files, "row_key").write.mode("overwrite").parquet(path)
