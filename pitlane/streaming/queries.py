"""Registered streaming queries (rows-only): they run a file-source stream to completion (availableNow)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pitlane.functions.risk import ers_raw
from pitlane.plans.catalog import cleaned, laps, live_duration_sql, live_status_sql, query
from pitlane.plans.oracle_sql import with_ctes
from pitlane.plans.model_queries import context
from pitlane.session import scratch_path
from pitlane.sinks import history as H
from pitlane.sources.laps import lap_table_path
from pitlane.streaming import lap_stream as LS

#: Files of the stored lap table that a micro-batch of these streams takes.
FILES_PER_BATCH = 16


def _stream(spark, sf, name):
    """(a scratch folder, the stored lap table's files as a stream: nothing is staged anew)."""
    source = laps(spark, sf)
    folder = lap_table_path(spark, sf)
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}"), LS.lap_stream(spark, folder, max_files_per_trigger=FILES_PER_BATCH).select(source.columns)


@query("stream_score")
def q_stream_score(spark, sf):
    """Lap files in, three model scores and alerts appended per micro-batch; returns safety_events."""
    ctx = context(spark, sf)
    base, src = _stream(spark, sf, "stream-score")
    q = LS.start_scoring(ctx, src, f"{base}/history", f"{base}/ckpt", available_now=True)
    q.awaitTermination()
    return H.read_table(spark, f"{base}/history", "safety_events")


@query("stream_feed", with_ctes(
    ["laps"], "SELECT row_key, driver, race, year, lap_number, position, compound, "
              f"{live_duration_sql()} AS superclipping_duration, {live_status_sql(live_duration_sql())} AS ers_status "
              "FROM laps"))
def q_stream_feed(spark, sf):
    """Live per-lap duration and status over arriving lap files (append mode, Parquet sink)."""
    base, src = _stream(spark, sf, "stream-feed")
    q = (LS.live_feed(src).writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


_FEED_LAPS = ("fl AS (SELECT race, year, driver, lap_number, " + ", ".join(
    f"arg_min({c}, row_key) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in LS.FEED_COLUMNS) + " FROM laps GROUP BY ALL)")


@query("stream_ordered_feed", with_ctes(
    ["laps"], "SELECT race, year, driver, row_number() OVER w - 1 AS lap_index, lap_number, count(*) OVER (PARTITION BY race, year, driver) AS total_laps, "
              "coalesce(position, 1) AS position, coalesce(compound, 'MEDIUM') AS compound, "
              f"{live_status_sql(live_duration_sql())} AS ers_status, {live_duration_sql()} AS superclipping_duration, "
              "row_number() OVER w = count(*) OVER (PARTITION BY race, year, driver) AS is_last FROM fl "
              "WINDOW w AS (PARTITION BY race, year, driver ORDER BY lap_number NULLS FIRST)", [_FEED_LAPS]))
def q_stream_ordered_feed(spark, sf):
    """R02 + W02: the ordered feed of every driver and race, from laps that arrive file by file."""
    base, src = _stream(spark, sf, "stream-ordered")
    LS.start_ordered_feed(src, base, f"{base}/ckpt", available_now=True).awaitTermination()
    return LS.ordered_feed(LS.current_laps(spark, base))


_STREAM_RISK = ("sr AS (SELECT *, (normalized_tyre_life * 2e0 + race_progress * 1.5e0 - greatest(-5e0, least(5e0, lap_time_delta)) - lo) "
                "/ nullif(hi - lo, 0e0) * 10e0 AS r FROM laps, bounds)")


def _dashboard(spark, sf, name):
    """One of the dashboard aggregates over arriving laps, kept up to date (complete mode) with the fixed risk
    bounds of a training run (min/max of the raw risk over the cleaned laps); each trigger rewrites the result table."""
    b = cleaned(spark, sf).agg(F.min(ers_raw()).alias("lo"), F.max(ers_raw()).alias("hi")).first()
    base, src = _stream(spark, sf, f"stream-{name}")
    agg = LS.dashboard_stream(src, (float(b["lo"]), float(b["hi"])))[name]
    q = (agg.writeStream.outputMode("complete")
         .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out"))
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(agg.schema).parquet(f"{base}/out")


@query("stream_dashboard", with_ctes(
    ["bounds"], "SELECT ers_status, count(*) AS n FROM (SELECT CASE "
                "WHEN r > -0.01e0 AND r <= 3e0 THEN 'NORMAL' WHEN r > 3e0 AND r <= 6e0 THEN 'ALERTA' "
                "WHEN r > 6e0 AND r <= 10.01e0 THEN 'CRÍTICO' END AS ers_status FROM sr) "
                "WHERE ers_status IS NOT NULL GROUP BY ers_status", [_STREAM_RISK]))
def q_stream_dashboard(spark, sf):
    """Status counts over arriving laps."""
    return _dashboard(spark, sf, "ers_distribution")


@query("stream_avg_duration", with_ctes(
    ["bounds"], "SELECT compound, round_even(avg(round_even((1e0 + r / 10e0 * 7e0) * 100e0, 0) / 100e0) * 1e2, 0) / 1e2 AS avg_duration "
                "FROM sr GROUP BY compound", [_STREAM_RISK]))
def q_stream_avg_duration(spark, sf):
    """Mean duration per compound over arriving laps."""
    return _dashboard(spark, sf, "avg_duration_by_compound")


@query("stream_avg_risk", with_ctes(
    ["bounds"], "SELECT lap_number, round_even(avg(r) * 1e2, 0) / 1e2 AS avg_risk FROM sr GROUP BY lap_number", [_STREAM_RISK]))
def q_stream_avg_risk(spark, sf):
    """Mean risk per lap number over arriving laps."""
    return _dashboard(spark, sf, "avg_risk_by_lap")
