"""Append-only history tables (K06-K12, K11), their latest-N reads (S07, T03) and record formatting.

Tables are Parquet directories partitioned by event_date, run_id and batch_id: reads
by time prune whole days, and a write replaces exactly the partitions of its run and
batch (dynamic partition overwrite). Run ids keep streams and jobs apart, which all
count their batches from 0. Row ids are deterministic (md5 of the source row key) and
so is a batch's time, which is noted at its first attempt, so a replay -- even on
another day -- writes the same rows to the same partitions.
Plain appends get a fresh run id.

compact() merges the small files of settled batches into a generation beside the table: rows and the list of the batches
they come from are written first, then an empty marker file puts the generation in force for readers, and only then are the
merged partitions removed. Readers take the newest generation and the table's partitions that it does not cover, so a
compaction that dies, or a batch that is written again, neither loses nor doubles a row.
"""

from __future__ import annotations

import os
import time
import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane import constants as C
from pitlane import schemas as S
from pitlane.functions import risk
from pitlane.functions.carstate import car_state_columns, speed
from pitlane.operators.dims import MAX_BROADCAST_ROWS, checked_dim, join_dim, materialize_counted
from pitlane.session import delete_path, list_names, path_exists, touch

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def iso_text(ts) -> Column:
    """timestamp as ISO text."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(c, ISO_FORMAT)


def table_path(base: str, table: str) -> str:
    if table not in S.HISTORY_TABLES:
        raise ValueError(f"unknown history table {table}")
    return os.path.join(base, table)


PARTITIONS = ["event_date", "run_id", "batch_id"]


def init_tables(spark: SparkSession, base: str) -> None:
    """Create the six tables if absent (empty Parquet with the fixed schema), in whatever store the path is."""
    for t in S.HISTORY_TABLES:
        p = table_path(base, t)
        if not path_exists(spark, p):
            empty = spark.createDataFrame([], S.history_schema(t))
            _partitioned(empty, "none", 0).write.mode("append").partitionBy(*PARTITIONS).parquet(p)


def _partitioned(df: DataFrame, run_id: str, batch_id: int) -> DataFrame:
    return df.withColumn("run_id", F.lit(quote(run_id, safe=""))).withColumn("batch_id", F.lit(int(batch_id)).cast("bigint"))


def batch_time(spark: SparkSession, base: str, run_id: str, batch_id: int) -> Column:
    """The time of a batch: that of its first attempt, kept as the name of a marker file beside the tables."""
    folder = os.path.join(base, "_batches", quote(run_id, safe=""), str(int(batch_id)))
    noted = list_names(spark, folder)
    if not noted:
        noted = [str(time.time_ns() // 1000)]
        touch(spark, os.path.join(folder, noted[0]))
    return F.timestamp_micros(F.lit(int(min(noted))))


def _stamp(df: DataFrame, table: str, key: Column, ts: Column | None) -> DataFrame:
    tcol = S.HISTORY_TIME_COLUMN.get(table, "timestamp")
    tsv = ts if ts is not None else F.current_timestamp()
    out = df.withColumn("id", F.md5(key.cast("string"))).withColumn(tcol, tsv)
    out = out.withColumn("event_date", F.to_date(F.col(tcol)))
    return out.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in S.history_schema(table).fields])


def history_rows(df: DataFrame, table: str, key: Column, ts: Column | None = None) -> DataFrame:
    """Shape payload columns into a history table's schema with id, time and date."""
    return _stamp(df, table, key, ts)


def append(df: DataFrame, base: str, table: str, batch_id: int | None = None, run_id: str | None = None) -> None:
    """Append rows; with a batch id the write replaces that run's batch (idempotent replay)."""
    p = table_path(base, table)
    out = _partitioned(df, run_id or ("default" if batch_id is not None else uuid.uuid4().hex), batch_id or 0)
    mode = "append" if batch_id is None else "overwrite"
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(p)


def read_table(spark: SparkSession, base: str, table: str, since: str | None = None) -> DataFrame:
    """The rows of a history table; since (a date) reads only the days from then on (partition pruning)."""
    names = S.history_schema(table).names
    df = _live(spark, base, table)
    gen = generation(spark, base, table)
    if gen:
        covered = checked_dim(spark.read.parquet(f"{_compact_path(base, table)}/covered-{gen}"))
        merged = spark.read.schema(S.history_schema(table)).parquet(f"{_compact_path(base, table)}/rows-{gen}")
        df = df.join(covered, ["run_id", "batch_id"], "left_anti").select(*names).unionByName(merged.select(*names))
    df = df.select(*names)
    return df if since is None else df.filter(F.col("event_date") >= F.lit(since).cast("date"))


def _live(spark: SparkSession, base: str, table: str) -> DataFrame:
    """The rows as batches have written them, with run and batch."""
    schema = T.StructType([*S.history_schema(table).fields, T.StructField("run_id", T.StringType()), T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(table_path(base, table))


def _compact_path(base: str, table: str) -> str:
    table_path(base, table)
    return os.path.join(base, "_compact", table)


def generation(spark: SparkSession, base: str, table: str) -> int:
    """The number of the compacted generation in force, 0 if there is none."""
    return max((int(n) for n in list_names(spark, f"{_compact_path(base, table)}/in_force")), default=0)


def compact(spark: SparkSession, base: str, table: str) -> int:
    """Merge settled batches into the next generation; how many were merged. A batch is settled if its run has gone on to a
    later one (streams write only their newest batch again) or was a plain append. Streams may run meanwhile."""
    streams = [n for n in list_names(spark, os.path.join(base, "_batches"))]
    own = _live(spark, base, table).select(*PARTITIONS).distinct()  # of the partitions' names, no column is read
    newest = Window.partitionBy("run_id")
    settled = own.withColumn("last", F.max("batch_id").over(newest)).where((F.col("batch_id") < F.col("last")) | ~F.col("run_id").isin(streams))
    gen, path = generation(spark, base, table), _compact_path(base, table)
    batches = settled.select("run_id", "batch_id").distinct()
    if gen:
        known = spark.read.parquet(f"{path}/covered-{gen}")
        batches = batches.join(known, ["run_id", "batch_id"], "left_anti")
    batches, n = materialize_counted(batches)
    if not n:
        return 0
    names = S.history_schema(table).names
    rows, covered = _live(spark, base, table).join(F.broadcast(batches) if n <= MAX_BROADCAST_ROWS else batches, ["run_id", "batch_id"]).select(*names), batches
    if gen:
        rows = rows.unionByName(spark.read.schema(S.history_schema(table)).parquet(f"{path}/rows-{gen}").select(*names))
        covered = covered.unionByName(known)
    rows.hint("rebalance", F.col("event_date")).write.mode("overwrite").partitionBy("event_date").parquet(f"{path}/rows-{gen + 1}")
    covered.coalesce(1).write.mode("overwrite").parquet(f"{path}/covered-{gen + 1}")
    touch(spark, f"{path}/in_force/{gen + 1}")
    folders = settled.join(batches, ["run_id", "batch_id"], "left_semi").collect()  # one row a merged partition
    for r in folders:
        day = "__HIVE_DEFAULT_PARTITION__" if r["event_date"] is None else str(r["event_date"])
        delete_path(spark, f"{table_path(base, table)}/event_date={day}/run_id={quote(r['run_id'], safe='')}/batch_id={r['batch_id']}")
    for old in range(1, gen):  # the last generation stays for readers that are still at it
        delete_path(spark, f"{path}/rows-{old}")
        delete_path(spark, f"{path}/covered-{old}")
    return n


def recent(df: DataFrame, k: int = C.RECENT_LIMIT, ts: str = "timestamp") -> DataFrame:
    """Newest k rows (ties by id), timestamps as ISO text, column names lower-cased.

    orderBy + limit plans as TakeOrderedAndProject: each task keeps k rows.
    """
    top = df.orderBy(F.col(ts).desc_nulls_last(), F.col("id")).limit(k)
    cols = [iso_text(c).alias(c.lower()) if c == ts else F.col(c).alias(c.lower())
            for c in df.columns if c not in PARTITIONS]
    return top.select(*cols)


def days_of(spark: SparkSession, base: str, table: str) -> list[str]:
    """The days that a table has partitions of, newest first, from the folder's names alone."""
    prefix, gen = "event_date=", generation(spark, base, table)
    folders = [table_path(base, table)] + ([f"{_compact_path(base, table)}/rows-{gen}"] if gen else [])
    names = {n[len(prefix):] for f in folders for n in list_names(spark, f) if n.startswith(prefix)}
    return sorted(names - {"__HIVE_DEFAULT_PARTITION__"}, reverse=True)


def recent_rows(spark: SparkSession, base: str, table: str, k: int = C.RECENT_LIMIT) -> DataFrame:
    """S07 on a stored table: its newest k rows, days opened from the newest until they hold k rows (a row's day is that of
    its time, so no older day can have a newer one). Each try opens twice as many days; rows without a time come last."""
    ts = S.HISTORY_TIME_COLUMN.get(table, "timestamp")
    days, n = days_of(spark, base, table), 1
    while n < len(days):
        newest = read_table(spark, base, table, since=days[n - 1])
        if newest.limit(k).count() >= k:
            return recent(newest, k, ts)
        n *= 2
    return recent(read_table(spark, base, table), k, ts)


# ------------------------------------------------------------------ producers of history rows

def alert_rows_from_events(events: DataFrame) -> DataFrame:
    """K07 from the event stream: every error event becomes a critical alert."""
    ev = events.filter(F.col("event_type") == "error")
    return history_rows(
        ev.select(F.lit(C.STATUS_CRITICAL).alias("severity"),
                  F.concat(F.lit("EVENT "), F.upper("event_type")).alias("title"),
                  F.coalesce(F.col("props"), F.lit("")).alias("description"),
                  F.col("event_id"), F.col("ts")),
        "alert_history", F.concat(F.lit("event#"), F.col("event_id").cast("string")), F.col("ts"))


def prediction_rows(feed: DataFrame, samples: DataFrame) -> DataFrame:
    """One superclipping prediction per telemetry sample of the feed driver.

    Each sample (time-stamped speeds on a lap) joins the feed lap it belongs to
    (one row per lap: a small, checked dimension); the lap's live duration and
    status are stored with the car state computed from the sample's own speeds.
    """
    lap = feed.select("lap_number", "race_progress", "tyre_life", "superclipping_duration", "ers_status")
    j = join_dim(samples, lap, "lap_number", "inner")
    j = j.withColumn("speed_kmh", speed())
    st = car_state_columns()
    payload = j.select(
        F.col("superclipping_duration").alias("predicted_laptime"), F.col("ers_status").alias("status"),
        st["velocidad_kmh"].alias("velocidad"), st["soc_bateria"].alias("soc_bateria"),
        st["mguk_kw"].alias("mguk_kw"), st["throttle_pct"].alias("throttle_pct"),
        st["aero_mode"].alias("aero_mode"), st["temp_bateria"].alias("temp_bateria"),
        "sample_id", "ts")
    return history_rows(payload, "superclipping_predictions",
                        F.concat(F.lit("sample#"), F.col("sample_id").cast("string")), F.col("ts"))


def lap_prediction_rows(laps: DataFrame, ts: Column | None = None) -> DataFrame:
    """K06 from laps: the live duration and status of each lap with the car state of its own speeds."""
    lap = with_speed(live_scored_laps(laps))
    st = car_state_columns()
    payload = lap.select(
        "row_key", F.col("superclipping_duration").alias("predicted_laptime"), F.col("ers_status").alias("status"),
        st["velocidad_kmh"].alias("velocidad"), st["soc_bateria"].alias("soc_bateria"),
        st["mguk_kw"].alias("mguk_kw"), st["throttle_pct"].alias("throttle_pct"),
        st["aero_mode"].alias("aero_mode"), st["temp_bateria"].alias("temp_bateria"))
    return history_rows(payload, "superclipping_predictions", F.col("row_key"), ts)


def with_speed(laps: DataFrame) -> DataFrame:
    """Laps with speed_kmh; laps without telemetry columns read as missing speeds."""
    absent = {c: F.lit(None).cast("double") for c in ("speed_fl", "speed_st") if c not in laps.columns}
    return laps.withColumns(absent).withColumn("speed_kmh", speed()) if absent else laps.withColumn("speed_kmh", speed())


def telemetry_rows(laps: DataFrame, ts: Column | None = None) -> DataFrame:
    """Lap rows for telemetry_data (nothing wrote this table in the analysed system)."""
    s = with_speed(laps)
    st = car_state_columns()
    payload = s.select(
        "row_key", F.col("lap_number").alias("lap"), "driver", "compound", "tyre_life",
        F.col("lap_time_s").alias("lap_time"), "position", "stint", st["velocidad_kmh"].alias("speed"),
        st["throttle_pct"].alias("throttle"), st["brake_pressure"].alias("brake"),
        F.lit(None).cast("double").alias("rpm"))
    return history_rows(payload, "telemetry_data", F.col("row_key"), ts)


def live_scored_laps(laps: DataFrame) -> DataFrame:
    """Row-local duration and status (F05, F06) for history producers."""
    d = laps.withColumn("superclipping_duration", risk.live_duration())
    return d.withColumn("ers_status", risk.live_status("superclipping_duration"))
