"""Lap feed: driver/race selection, per-lap consolidation, telemetry join, cursor (P05-P08, A06, A07,
A11, A15, J01, T01, W02-W04).

The feed of one driver in one race is small (one row per lap), but every step
that reads the lap or telemetry table is a filter or a partial aggregate, so
the work scales with the tables and no raw group is collected in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlane import constants as C
from pitlane.functions import risk
from pitlane.functions.carstate import car_state_columns, speed
from pitlane.operators.dims import join_dim, scalar
from pitlane.operators.sampling import top_k_per_group


def driver_laps(laps: DataFrame, driver: str = C.FEED_DRIVER) -> DataFrame:
    """Laps of one driver."""
    return laps.filter(F.col("driver") == F.lit(driver))


def race_matches(df: DataFrame, pattern: str = C.FEED_RACE_PATTERN) -> Column:
    """Case-insensitive pattern match; a missing race is no match."""
    return F.coalesce(F.col("race").rlike(f"(?i){pattern}"), F.lit(False))


def race_counts(df: DataFrame) -> DataFrame:
    return df.filter(F.col("race").isNotNull()).groupBy("race").agg(F.count(F.lit(1)).alias("n"))


def mode_race(df: DataFrame) -> Column:
    """Most frequent race; ties go to the alphabetically first race (scalar subquery)."""
    return scalar(race_counts(df), F.min_by("race", F.struct((-F.col("n")).alias("neg_n"), F.col("race"))))


def chosen_race(df: DataFrame, pattern: str = C.FEED_RACE_PATTERN) -> Column:
    """First matching race (alphabetical: there is no file order), else the most frequent race."""
    matched = scalar(df.filter(race_matches(df, pattern)), F.min("race"))
    return F.coalesce(matched, mode_race(df))


def feed_laps(laps: DataFrame, driver: str = C.FEED_DRIVER, pattern: str = C.FEED_RACE_PATTERN) -> DataFrame:
    """P05 + P06/A11 + P07: the chosen driver's laps of the chosen race, with the race name attached."""
    d = driver_laps(laps, driver)
    race = chosen_race(d, pattern)
    return d.filter(F.col("race") == race).withColumn("race_name", race)


def first_per_lap(df: DataFrame, keys=("lap_number",), order=("year", "row_key"),
                  columns: list[str] | None = None) -> DataFrame:
    """Per lap, the first non-null value of every column in (year, row key) order.

    `min_by(c, ordering)` with a null ordering for null values skips them; the
    aggregate is partial (map-side) so a lap with many rows is never collected.
    """
    keys = list(keys)
    cols = columns or [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(o) for o in order])
    aggs = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), ordering)).alias(c) for c in cols]
    return df.groupBy(*keys).agg(*aggs)


def telemetry_by_lap(telemetry: DataFrame, team: str = C.FEED_TEAM, driver: str = C.FEED_DRIVER) -> DataFrame:
    """P08 + A06: mean speeds per lap of one team and driver."""
    t = telemetry.filter((F.col("team") == team) & (F.col("driver") == driver))
    return t.groupBy("lap_number").agg(F.avg("speed_fl").alias("speed_fl"), F.avg("speed_st").alias("speed_st"))


def feed_with_telemetry(feed: DataFrame, telemetry: DataFrame, team: str = C.FEED_TEAM,
                        driver: str = C.FEED_DRIVER) -> DataFrame:
    """Left join on lap number only (one row per lap on the telemetry side)."""
    per_lap = telemetry_by_lap(telemetry, team, driver)
    return join_dim(feed, per_lap, "lap_number", "left")


def build_feed(laps: DataFrame, telemetry: DataFrame | None = None, driver: str = C.FEED_DRIVER,
               pattern: str = C.FEED_RACE_PATTERN, team: str = C.FEED_TEAM) -> DataFrame:
    """The reference feed: select, consolidate per lap, join telemetry, add live duration and status."""
    f = feed_laps(laps, driver, pattern)
    f = first_per_lap(f)
    if telemetry is not None:
        f = feed_with_telemetry(f, telemetry, team, driver)
    else:
        f = f.withColumn("speed_fl", F.lit(None).cast("double")).withColumn("speed_st", F.lit(None).cast("double"))
    f = f.withColumn("superclipping_duration", risk.live_duration())
    return f.withColumn("ers_status", risk.live_status("superclipping_duration"))


def feed_payload(feed: DataFrame) -> DataFrame:
    """W02 + P10 + A15: ordered cursor over the feed (index, totals, last flag) and the 7-field payload."""
    w = Window.partitionBy("driver", "race_name").orderBy("lap_number")
    wall = Window.partitionBy("driver", "race_name")
    return feed.select(
        (F.row_number().over(w) - 1).alias("lap_index"),
        F.col("lap_number").cast("int").alias("lap_number"),
        F.count(F.lit(1)).over(wall).alias("total_laps"),
        F.coalesce(F.col("position").cast("int"), F.lit(1)).alias("position"),
        F.coalesce(F.col("compound"), F.lit("MEDIUM")).alias("compound"),
        "ers_status",
        "superclipping_duration",
        (F.row_number().over(w) == F.count(F.lit(1)).over(wall)).alias("is_last"),
    )


def car_state(feed: DataFrame) -> DataFrame:
    """F12 over the feed rows (speed from telemetry, else 280)."""
    f = feed.withColumn("speed_kmh", speed())
    cols = car_state_columns()
    return f.select("lap_number", *[v.alias(k) for k, v in cols.items()])


def per_lap_rows(laps: DataFrame, keys=("race", "year", "driver", "lap_number")) -> DataFrame:
    """One row per (race, year, driver, lap): first non-null values (A07 generalised)."""
    cols = ["lap_time_s", "tyre_life", "position", "compound", "lap_time_delta"]
    return first_per_lap(laps, keys=keys, order=("row_key",), columns=cols)


def trailing_history(laps: DataFrame, n: int = C.TRAILING_LAPS) -> DataFrame:
    """Trailing n laps of lap time and tyre life per (race, year, driver).

    Computed over one row per lap, so a window partition holds one driver's laps
    of one race: bounded by the number of laps, whatever the table size.
    """
    per_lap = per_lap_rows(laps)
    w = Window.partitionBy("race", "year", "driver").orderBy("lap_number").rowsBetween(-(n - 1), 0)
    return per_lap.select(
        "race", "year", "driver", "lap_number",
        F.collect_list(F.struct(F.col("lap_number").alias("t"), F.col("lap_time_s").alias("v"))).over(w)
         .alias("lap_time_history"),
        F.collect_list(F.struct(F.col("lap_number").alias("t"), F.col("tyre_life").alias("v"))).over(w)
         .alias("tyre_life_history"),
    )


def leaderboard(laps: DataFrame, highlight_driver: str = C.FEED_DRIVER, k: int = C.LEADERBOARD_SIZE) -> DataFrame:
    """Top k by position per (race, year, lap); gap to the leader's lap time; highlight flag.

    The rank filter is pushed below the shuffle (partial group limit), so a hot
    (race, year, lap) costs k rows per map task.
    """
    keys = ["race", "year", "lap_number"]
    order = [F.col("position"), F.col("row_key")]
    top = top_k_per_group(laps.select("row_key", *keys, "position", "driver", "lap_time_s"), keys, order, k)
    lead = Window.partitionBy(*keys).orderBy("rank_in_group")
    return top.select(
        *keys, F.col("rank_in_group").cast("int").alias("slot"), "position", "driver",
        (F.col("lap_time_s") - F.first("lap_time_s").over(lead)).alias("gap_s"),
        (F.col("driver") == highlight_driver).alias("highlight"),
    )


def leaderboard_nested(board: DataFrame) -> DataFrame:
    """Nested form: one array of at most k records per (race, year, lap)."""
    return board.groupBy("race", "year", "lap_number").agg(
        F.array_sort(F.collect_list(F.struct("slot", "position", "driver", "gap_s", "highlight"))).alias("leaderboard"))
