"""Registered queries: one Spark DataFrame builder per operator, plus the DuckDB oracle SQL.

Every query reads the shared test tables (or frames Spark derives from them) in
full. Output columns are flat scalars with explicit aliases; doubles that are
aggregated are rounded with the floor rule (both engines) so that summation
order does not change the compared values.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlane.functions.numeric import round_half_up as rh
from pitlane.operators import clean as CL
from pitlane.operators import dashboards as DB
from pitlane.operators import sampling as SM
from pitlane.operators.sampling import hash_sql
from pitlane.plans.oracle_sql import r, with_ctes
from pitlane.schemas import REGRESSION_FEATURES, REGRESSION_TARGET
from pitlane.session import ensure_checkpoint_dir
from pitlane.operators.stored import stored
from pitlane.sources.laps import testdata_lap_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def laps(spark: SparkSession, sf: str) -> DataFrame:
    """The lap table of the input folder (derived once, stored partitioned by year)."""
    ensure_checkpoint_dir(spark)
    return testdata_lap_table(spark, sf)


def cleaned(spark, sf) -> DataFrame:
    """The cleaned laps (P01-P04) of the stored lap table. Only the trim's threshold, which takes passes over all laps, is
    stored, once per application and input; with it the rules are a filter, which costs less than a second copy of the laps."""
    whole = CL.drop_incomplete(laps(spark, sf))
    limit = stored(spark, sf, "trim", lambda: spark.range(1).select(CL.trim_threshold(whole).alias("limit")))
    return CL.clean_rows(laps(spark, sf), limit.select("limit").scalar())


def scored(spark, sf) -> DataFrame:
    """Clean rows with the dashboard fields (no model encodings)."""
    return CL.dashboard_fields(cleaned(spark, sf))


def prepared(spark, sf) -> DataFrame:
    """Clean rows, encodings and dashboard fields (the training frame)."""
    return CL.prepare_clean(cleaned(spark, sf))


LAP_COLS = ["row_key", "driver", "race", "year", "lap_number", "stint", "position", "lap_time_s",
            "tyre_life", "compound", "lap_time_delta", "normalized_tyre_life", "race_progress",
            "cumulative_degradation", "position_change", "prev_tyre_life", "pit_stop"]
LAP_COLS_SQL = ", ".join(LAP_COLS)


# --------------------------------------------------------------------------- scans and cleaning

@query("laps_scan", with_ctes(["laps"], f"SELECT {LAP_COLS_SQL} FROM laps"))
def q_laps_scan(spark, sf):
    """The lap table with its fixed schema."""
    return laps(spark, sf).select(*LAP_COLS)


@query("clean_dropna", with_ctes(["p01"], f"SELECT {LAP_COLS_SQL} FROM p01"))
def q_clean_dropna(spark, sf):
    """P01."""
    return CL.drop_incomplete(laps(spark, sf)).select(*LAP_COLS)


@query("laptime_stats", with_ctes(["p01"], f"SELECT {r('median(lap_time_s)', 6)} AS median_s, "
                                           f"{r('stddev_samp(lap_time_s)', 6)} AS std_s, "
                                           "count(*) AS n FROM p01"))
def q_laptime_stats(spark, sf):
    """A01 over the complete rows."""
    p01 = CL.drop_incomplete(laps(spark, sf))
    st = CL.laptime_stats(p01)
    return st.select(rh("median_s", 6).alias("median_s"), rh("std_s", 6).alias("std_s"),
                     p01.select(F.count(F.lit(1))).scalar().alias("n"))


@query("clean_outlier_trim", with_ctes(["trimmed"], f"SELECT {LAP_COLS_SQL} FROM trimmed"))
def q_clean_outlier_trim(spark, sf):
    """P02 after P01."""
    return CL.trim_outliers(CL.drop_incomplete(laps(spark, sf))).select(*LAP_COLS)


@query("clean_position_range", with_ctes(["trimmed"], f"SELECT {LAP_COLS_SQL} FROM trimmed "
                                                      "WHERE position BETWEEN 1 AND 20"))
def q_clean_position_range(spark, sf):
    """P03 after P01, P02."""
    return CL.position_range(CL.trim_outliers(CL.drop_incomplete(laps(spark, sf)))).select(*LAP_COLS)


@query("clean_full", with_ctes(["clean"], f"SELECT {LAP_COLS_SQL} FROM clean"))
def q_clean_full(spark, sf):
    """P01-P04."""
    return cleaned(spark, sf).select(*LAP_COLS)


# --------------------------------------------------------------------------- risk and dashboards

@query("ers_raw", with_ctes(["raw"], "SELECT row_key, ers_raw FROM raw"))
def q_ers_raw(spark, sf):
    """F01."""
    from pitlane.functions.risk import ers_raw
    return cleaned(spark, sf).select("row_key", ers_raw().alias("ers_raw"))


@query("ers_bounds", with_ctes(["bounds"], "SELECT lo AS ers_min, hi AS ers_max FROM bounds"))
def q_ers_bounds(spark, sf):
    """A03."""
    from pitlane.functions.risk import ers_raw
    return cleaned(spark, sf).agg(F.min(ers_raw()).alias("ers_min"), F.max(ers_raw()).alias("ers_max"))


@query("ers_risk", with_ctes(["risk"], f"SELECT row_key, {r('ers_risk', 9)} AS ers_risk FROM risk"))
def q_ers_risk(spark, sf):
    """F02 with J03 (global bounds as scalar subqueries)."""
    return scored(spark, sf).select("row_key", rh("ers_risk", 9).alias("ers_risk"))


@query("ers_status", with_ctes(["status"], "SELECT row_key, ers_status FROM status"))
def q_ers_status(spark, sf):
    """F03."""
    return scored(spark, sf).select("row_key", "ers_status")


@query("superclip_duration", with_ctes(["status"], "SELECT row_key, superclipping_duration FROM status"))
def q_superclip_duration(spark, sf):
    """F04."""
    return scored(spark, sf).select("row_key", "superclipping_duration")


@query("ers_distribution", with_ctes(
    ["status"],
    "SELECT l.ers_status, CAST(coalesce(c.n, 0) AS BIGINT) AS n, l.level_order FROM "
    "(VALUES (0, 'NORMAL'), (1, 'ALERTA'), (2, 'CRÍTICO')) l(level_order, ers_status) "
    "LEFT JOIN (SELECT ers_status, count(*) AS n FROM status WHERE ers_status IS NOT NULL "
    "GROUP BY ers_status) c ON l.ers_status = c.ers_status"))
def q_ers_distribution(spark, sf):
    """Count per status including empty levels."""
    return DB.ers_distribution(scored(spark, sf))


@query("avg_duration_by_compound", with_ctes(
    ["status"], "SELECT compound, round_even(avg(superclipping_duration) * 1e2, 0) / 1e2 AS avg_duration "
                "FROM status GROUP BY compound"))
def q_avg_duration_by_compound(spark, sf):
    """A09."""
    return DB.avg_duration_by_compound(scored(spark, sf))


@query("avg_risk_by_lap", with_ctes(
    ["status"], "SELECT lap_number, round_even(avg(ers_risk) * 1e2, 0) / 1e2 AS avg_risk "
                "FROM status GROUP BY lap_number"))
def q_avg_risk_by_lap(spark, sf):
    """A10."""
    return DB.avg_risk_by_lap(scored(spark, sf))


# --------------------------------------------------------------------------- encodings

@query("race_median", with_ctes(["clean"], f"SELECT race, {r('median(lap_time_s)', 6)} AS laptime_baseline "
                                           "FROM clean GROUP BY race"))
def q_race_median(spark, sf):
    """A02 (the null race is its own group here; it gets no baseline in race_baseline)."""
    m = CL.race_medians(cleaned(spark, sf))
    return m.select("race", rh("laptime_baseline", 6).alias("laptime_baseline"))


@query("race_baseline", with_ctes(["enc"], f"SELECT row_key, {r('laptime_baseline', 6)} AS laptime_baseline, "
                                           f"{r('laptime_normalized', 6)} AS laptime_normalized FROM enc"))
def q_race_baseline(spark, sf):
    """J02 + F10."""
    out = CL.attach_race_baseline(cleaned(spark, sf))
    return out.select("row_key", rh("laptime_baseline", 6).alias("laptime_baseline"),
                      rh("laptime_normalized", 6).alias("laptime_normalized"))


@query("race_encode", with_ctes(["enc"], "SELECT row_key, coalesce(race, 'nan') AS race_text, race_encoded FROM enc"))
def q_race_encode(spark, sf):
    """Zero-based alphabetical race code; missing race encodes the text 'nan'."""
    out = CL.attach_race_code(cleaned(spark, sf))
    return out.select("row_key", CL.race_text().alias("race_text"), "race_encoded")


@query("race_code_dictionary", with_ctes(
    ["laps"], "SELECT t AS race_text, CAST(row_number() OVER (ORDER BY version, t) - 1 AS INTEGER) AS race_encoded, CAST(version AS INTEGER) AS version "
              "FROM (SELECT coalesce(race, 'nan') AS t, CASE WHEN min(year) < (SELECT max(year) FROM laps) THEN 1 ELSE 2 END AS version "
              "FROM laps WHERE year IS NOT NULL GROUP BY 1)"))
def q_race_code_dictionary(spark, sf):
    """W01 across runs: codes of all years but the last, then extended by the races of the last without moving any."""
    from pitlane.operators.codes import extend_codes
    lp = laps(spark, sf).where(F.col("year").isNotNull())
    last = lp.agg(F.max("year")).first()[0]
    return extend_codes(extend_codes(None, lp.where(F.col("year") < last)), lp)


@query("year_offset", with_ctes(["enc"], "SELECT row_key, year, year_encoded FROM enc"))
def q_year_offset(spark, sf):
    """A04 + F11."""
    return CL.attach_year_offset(cleaned(spark, sf)).select("row_key", "year", "year_encoded")


@query("compound_encode", with_ctes(
    ["laps"], "SELECT row_key, compound, CAST(CASE compound WHEN 'SOFT' THEN 0 WHEN 'MEDIUM' THEN 1 "
              "WHEN 'HARD' THEN 2 WHEN 'INTERMEDIATE' THEN 3 WHEN 'WET' THEN 4 ELSE 1 END AS DOUBLE) "
              "AS compound_encoded FROM laps"))
def q_compound_encode(spark, sf):
    """Literal map with default."""
    from pitlane.functions.lookup import compound_code
    return laps(spark, sf).select("row_key", "compound", compound_code().alias("compound_encoded"))


@query("row_accounting", with_ctes(
    ["clean"],
    "SELECT n_raw, n_clean, n_complete, n_raw - n_clean AS n_removed FROM "
    "(SELECT (SELECT count(*) FROM laps) AS n_raw, (SELECT count(*) FROM clean) AS n_clean, "
    "(SELECT count(*) FROM clean WHERE position_change IS NOT NULL AND prev_tyre_life IS NOT NULL "
    "AND pit_stop IS NOT NULL AND race IS NOT NULL) AS n_complete)"))
def q_row_accounting(spark, sf):
    """Raw, clean, complete-feature and removed row counts."""
    return CL.row_accounting(laps(spark, sf)).select("n_raw", "n_clean", "n_complete", "n_removed")


# --------------------------------------------------------------------------- critical-event rule

def _event_frame(spark, sf):
    """Scored laps with the F19 label (the same operator the SVM family trains on)."""
    from pitlane.plans.safety import with_event_label
    return with_event_label(scored(spark, sf))


EVENT_CTE = ("ev AS (SELECT status.*, CASE WHEN (lap_time_delta > p95 OR lap_time_delta < p5) "
             "AND ers_risk > 7e0 THEN 1 ELSE 0 END AS evento_critico FROM status, "
             "(SELECT quantile_cont(lap_time_delta, 0.05) AS p5, quantile_cont(lap_time_delta, 0.95) AS p95 "
             "FROM status) q)")


@query("delta_percentiles", with_ctes(["status"], f"SELECT {r('quantile_cont(lap_time_delta, 0.05)', 9)} AS p5, "
                                                  f"{r('quantile_cont(lap_time_delta, 0.95)', 9)} AS p95 FROM status"))
def q_delta_percentiles(spark, sf):
    """Exact linear-interpolated 5th/95th percentiles."""
    s = CL.quantiles(scored(spark, sf), "lap_time_delta", [0.05, 0.95])
    return s.select(rh(F.col("q")[0], 9).alias("p5"), rh(F.col("q")[1], 9).alias("p95"))


@query("critical_event", with_ctes(["status"], "SELECT row_key, evento_critico FROM ev", [EVENT_CTE]))
def q_critical_event(spark, sf):
    """F19 with A05 + J03."""
    return _event_frame(spark, sf).select("row_key", "evento_critico")


@query("class_balance", with_ctes(
    ["status"], f"SELECT CAST(sum(evento_critico) AS BIGINT) AS n_critical, "
                f"CAST(count(*) - sum(evento_critico) AS BIGINT) AS n_normal, "
                f"{r('avg(evento_critico) * 100e0', 2)} AS critical_pct FROM ev", [EVENT_CTE]))
def q_class_balance(spark, sf):
    """A13."""
    e = _event_frame(spark, sf)
    return e.agg(F.sum("evento_critico").cast("bigint").alias("n_critical"),
                 (F.count(F.lit(1)) - F.sum("evento_critico")).cast("bigint").alias("n_normal"),
                 rh(F.avg("evento_critico") * 100.0, 2).alias("critical_pct"))


@query("class_weights", with_ctes(
    ["status"], f"SELECT evento_critico AS label, n, {r('tot / (k * n)', 9)} AS weight FROM "
                "(SELECT evento_critico, count(*) AS n FROM ev GROUP BY evento_critico) c, "
                "(SELECT count(*) * 1e0 AS tot, count(DISTINCT evento_critico) * 1e0 AS k FROM ev) t",
    [EVENT_CTE]))
def q_class_weights(spark, sf):
    """ML10: balanced weight n / (classes * count)."""
    from pitlane.plans.models import class_weights
    w = class_weights(_event_frame(spark, sf), "evento_critico")
    return w.select(F.col("evento_critico").alias("label"), "n", rh("weight", 9).alias("weight"))


# --------------------------------------------------------------------------- lap feed

def _telemetry(spark, sf):
    from pitlane.sources.telemetry import telemetry_from_testdata
    return telemetry_from_testdata(spark, sf)


FEED_SQL = [
    "ver AS (SELECT * FROM laps WHERE driver = 'VER')",
    "pick AS (SELECT coalesce((SELECT min(race) FROM ver WHERE coalesce(regexp_matches(race, '(?i)Monaco'), false)), "
    "(SELECT race FROM (SELECT race, count(*) AS n FROM ver WHERE race IS NOT NULL GROUP BY race) "
    "ORDER BY n DESC, race LIMIT 1)) AS race_name)",
    "feed AS (SELECT ver.*, pick.race_name FROM ver, pick WHERE ver.race = pick.race_name)",
]
_FIRST_COLS = [c for c in LAP_COLS if c != "lap_number"] + ["race_name"]
FIRST_SQL = ("fpl AS (SELECT lap_number, " + ", ".join(
    f"min_by({c}, printf('%04d|%s', year, row_key)) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _FIRST_COLS)
    + " FROM feed GROUP BY lap_number)")
TEL_SQL = ("tel AS (SELECT lap_number, avg(speed_fl) AS speed_fl, avg(speed_st) AS speed_st FROM telemetry "
           "WHERE team = 'Red Bull Racing' AND driver = 'VER' GROUP BY lap_number)")
FEEDT_SQL = "feedt AS (SELECT fpl.*, tel.speed_fl, tel.speed_st FROM fpl LEFT JOIN tel USING (lap_number))"


def live_duration_sql(ntl="normalized_tyre_life", prog="race_progress", delta="lap_time_delta", life="tyre_life"):
    lf = f"(CASE WHEN {life} IS NULL OR {life} = 0 THEN 1e0 ELSE {life} END)"
    rr = (f"{ntl} * 0.35e0 + {prog} * 0.3e0 + greatest(0e0, -coalesce({delta}, 0e0)) * 0.2e0 "
          f"+ {lf} / 40e0 * 0.15e0")
    d = f"greatest(1.5e0, least(7.5e0, round_even((2e0 + ({rr}) * 4.5e0) * 100e0, 0) / 100e0))"
    return f"(CASE WHEN {ntl} IS NULL OR {prog} IS NULL OR {life} IS NULL THEN 7.5e0 ELSE {d} END)"


def live_status_sql(d):
    return (f"(CASE WHEN {d} >= 2e0 AND {d} <= 4e0 THEN 'NORMAL' WHEN {d} > 4e0 AND {d} <= 5.5e0 THEN 'ALERTA' "
            "ELSE 'CRÍTICO' END)")


def _feed(spark, sf, with_telemetry=True):
    from pitlane.operators import feed as FD
    return FD.build_feed(laps(spark, sf), _telemetry(spark, sf) if with_telemetry else None)


@query("telemetry_scan", with_ctes(["telemetry"], "SELECT team, driver, lap_number, speed_fl, speed_st FROM telemetry"))
def q_telemetry_scan(spark, sf):
    """Telemetry rows with the fixed schema."""
    return _telemetry(spark, sf)


@query("driver_laps", with_ctes(["laps"], f"SELECT {LAP_COLS_SQL} FROM laps WHERE driver = 'VER'"))
def q_driver_laps(spark, sf):
    """P05."""
    from pitlane.operators.feed import driver_laps
    return driver_laps(laps(spark, sf)).select(*LAP_COLS)


@query("race_pattern", with_ctes(["laps"], f"SELECT {LAP_COLS_SQL} FROM laps WHERE driver = 'VER' "
                                           "AND coalesce(regexp_matches(race, '(?i)Monaco'), false)"))
def q_race_pattern(spark, sf):
    """P06 on the driver's laps."""
    from pitlane.operators.feed import driver_laps, race_matches
    d = driver_laps(laps(spark, sf))
    return d.filter(race_matches(d)).select(*LAP_COLS)


@query("mode_race", with_ctes(["laps"], "SELECT race, n FROM (SELECT race, count(*) AS n FROM laps "
                                        "WHERE driver = 'VER' AND race IS NOT NULL GROUP BY race) "
                                        "ORDER BY n DESC, race LIMIT 1"))
def q_mode_race(spark, sf):
    """Most frequent race of the driver (top-1 is the feature; ties alphabetical)."""
    from pitlane.operators.feed import driver_laps, race_counts
    return race_counts(driver_laps(laps(spark, sf))).orderBy(F.desc("n"), "race").limit(1)


@query("feed_laps", with_ctes(["laps"], f"SELECT {LAP_COLS_SQL}, race_name FROM feed", FEED_SQL))
def q_feed_laps(spark, sf):
    """The chosen race of the driver (pattern match, else the most frequent race)."""
    from pitlane.operators.feed import feed_laps
    return feed_laps(laps(spark, sf)).select(*LAP_COLS, "race_name")


@query("first_per_lap", with_ctes(["laps"], "SELECT * FROM fpl", FEED_SQL + [FIRST_SQL]))
def q_first_per_lap(spark, sf):
    """First non-null value per column and lap, in (year, row key) order."""
    from pitlane.operators.feed import feed_laps, first_per_lap
    return first_per_lap(feed_laps(laps(spark, sf)).select(*LAP_COLS, "race_name"))


@query("telemetry_by_lap", with_ctes(["telemetry"], f"SELECT lap_number, {r('speed_fl', 6)} AS speed_fl, "
                                                    f"{r('speed_st', 6)} AS speed_st FROM tel", [TEL_SQL]))
def q_telemetry_by_lap(spark, sf):
    """P08 + A06."""
    from pitlane.operators.feed import telemetry_by_lap
    t = telemetry_by_lap(_telemetry(spark, sf))
    return t.select("lap_number", rh("speed_fl", 6).alias("speed_fl"), rh("speed_st", 6).alias("speed_st"))


@query("feed_with_telemetry", with_ctes(
    ["laps", "telemetry"], f"SELECT lap_number, row_key, position, {r('speed_fl', 6)} AS speed_fl, "
                           f"{r('speed_st', 6)} AS speed_st FROM feedt", FEED_SQL + [FIRST_SQL, TEL_SQL, FEEDT_SQL]))
def q_feed_with_telemetry(spark, sf):
    """Feed laps left-joined with per-lap telemetry means on lap number."""
    f = _feed(spark, sf)
    return f.select("lap_number", "row_key", "position", rh("speed_fl", 6).alias("speed_fl"),
                    rh("speed_st", 6).alias("speed_st"))


@query("feed_payload", with_ctes(
    ["laps", "telemetry"],
    "SELECT CAST(row_number() OVER w - 1 AS INTEGER) AS lap_index, lap_number, count(*) OVER wa AS total_laps, "
    "coalesce(position, 1) AS position, coalesce(compound, 'MEDIUM') AS compound, "
    f"{live_status_sql(live_duration_sql())} AS ers_status, {live_duration_sql()} AS superclipping_duration, "
    "row_number() OVER w = count(*) OVER wa AS is_last FROM feedt "
    "WINDOW w AS (PARTITION BY driver, race_name ORDER BY lap_number), wa AS (PARTITION BY driver, race_name)",
    FEED_SQL + [FIRST_SQL, TEL_SQL, FEEDT_SQL]))
def q_feed_payload(spark, sf):
    """W02 + P10 + A15 + F05/F06: the ordered lap payloads of the feed."""
    from pitlane.operators.feed import feed_payload
    return feed_payload(_feed(spark, sf)).withColumn("lap_index", F.col("lap_index").cast("int"))


def _speed_sql():
    return ("(CASE WHEN speed_fl IS NOT NULL AND speed_fl <> 0 THEN speed_fl "
            "WHEN speed_st IS NOT NULL AND speed_st <> 0 THEN speed_st ELSE 280e0 END)")


def _car_state_sql():
    s = _speed_sql()
    thr = f"greatest(0e0, least(100e0, 55e0 + ({s} - 200e0) * 0.25e0))"
    brk = f"greatest(0e0, least(100e0, 100e0 - {thr} * 0.8e0))"
    prog = "(CASE WHEN race_progress IS NULL OR race_progress = 0 THEN 0.5e0 ELSE race_progress END)"
    soc = f"greatest(30e0, 85e0 - {prog} * 40e0)"

    def rd(x):
        return f"round_even(({x}) * 10e0, 0) / 10e0"
    return (f"SELECT lap_number, {rd(s)} AS velocidad_kmh, {rd(soc)} AS soc_bateria, {rd(thr)} AS throttle_pct, "
            f"{rd(brk)} AS brake_pressure, {rd(f'280e0 + {thr} * 0.8e0')} AS mguk_kw, "
            f"CASE WHEN {s} > 250e0 THEN 'STRAIGHT MODE' ELSE 'CORNER MODE' END AS aero_mode, "
            f"{rd('38e0 + tyre_life * 0.4e0')} AS temp_bateria FROM feedt")


@query("car_state", with_ctes(["laps", "telemetry"], _car_state_sql(), FEED_SQL + [FIRST_SQL, TEL_SQL, FEEDT_SQL]))
def q_car_state(spark, sf):
    """F12 over the feed with telemetry speeds."""
    from pitlane.operators.feed import car_state
    return car_state(_feed(spark, sf))


@query("superclip_row", with_ctes(["laps"], f"SELECT row_key, {live_duration_sql()} AS superclipping_duration, "
                                            f"{live_status_sql(live_duration_sql())} AS ers_status FROM laps"))
def q_superclip_row(spark, sf):
    """F05 + F06 on every lap."""
    from pitlane.functions.risk import live_duration, live_status
    return (laps(spark, sf).select("row_key", live_duration().alias("superclipping_duration"))
            .withColumn("ers_status", live_status("superclipping_duration")))


def _live_risk_sql():
    raw = ("normalized_tyre_life * 2e0 + race_progress * 1.5e0 - "
           "coalesce(greatest(-5e0, least(5e0, lap_time_delta)), 5e0)")
    v = f"greatest(0e0, least(10e0, ({raw}) * 0.65e0 + 2.5e0))"
    return (f"CASE WHEN normalized_tyre_life IS NULL OR race_progress IS NULL THEN 10e0 "
            f"ELSE round_even(({v}) * 100e0, 0) / 100e0 END")


@query("live_risk", with_ctes(["laps"], f"SELECT row_key, {_live_risk_sql()} AS live_risk FROM laps"))
def q_live_risk(spark, sf):
    """F07 on every lap."""
    from pitlane.functions.risk import live_risk
    return laps(spark, sf).select("row_key", live_risk().alias("live_risk"))


def _missing_sql(names):
    parts = ", ".join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in names)
    return f"nullif(concat_ws(',', {parts}), '')"


@query("score_inputs", with_ctes(
    ["laps"], f"SELECT row_key, lap_number AS lap, {_live_risk_sql()} AS ers_risk, laptime_normalized, "
              f"{_missing_sql(['normalized_tyre_life', 'race_progress', 'lap_time_delta', 'tyre_life'])} AS missing_risk_class, "
              f"{_missing_sql(['cumulative_degradation', 'tyre_life', 'laptime_normalized'])} AS missing_clusters, "
              f"{_missing_sql(['lap_time_delta', 'race_progress', 'tyre_life'])} AS missing_safety FROM "
              "(SELECT *, round_even(((CASE WHEN lap_time_s = 0 THEN 78e0 ELSE lap_time_s END) - 78e0) * 10000e0, 0) / 10000e0 "
              "AS laptime_normalized FROM laps)"))
def q_score_inputs(spark, sf):
    """P12 + F07 + F08: what the three scorers see of every lap, and the features that each one misses."""
    from pitlane.plans.scoring import scoring_inputs
    return scoring_inputs(laps(spark, sf))


@query("laptime_vs_constant", with_ctes(
    ["laps"], "SELECT row_key, round_even(((CASE WHEN lap_time_s = 0 THEN 78e0 ELSE lap_time_s END) - 78e0) "
              "* 10000e0, 0) / 10000e0 AS laptime_normalized_live FROM laps"))
def q_laptime_vs_constant(spark, sf):
    """F08."""
    from pitlane.functions.risk import laptime_vs_constant
    return laps(spark, sf).select("row_key", laptime_vs_constant().alias("laptime_normalized_live"))


@query("status_color", with_ctes(
    ["status"], "SELECT row_key, ers_status, CASE ers_status WHEN 'NORMAL' THEN '#00ff88' "
                "WHEN 'ALERTA' THEN '#ffcc00' WHEN 'CRÍTICO' THEN '#cc0000' ELSE '#cc0000' END AS color FROM status"))
def q_status_color(spark, sf):
    """F16."""
    from pitlane.functions.lookup import status_color
    return scored(spark, sf).select("row_key", "ers_status", status_color().alias("color"))


@query("race_gaps", with_ctes(
    ["laps"], "SELECT row_key, CAST(lap_number % 3 + 1 AS INTEGER) AS sector, "
              "round_even((0.5e0 + lap_time_delta * 0.1e0) * 1000e0, 0) / 1000e0 AS gap_ahead, "
              "round_even((0.8e0 + abs(position_change) * 0.05e0) * 1000e0, 0) / 1000e0 AS gap_behind FROM laps"))
def q_race_gaps(spark, sf):
    """F13 on every lap."""
    from pitlane.functions.carstate import race_gap_columns
    cols = race_gap_columns()
    return laps(spark, sf).select("row_key", *[v.alias(k) for k, v in cols.items()])


_GAPS_SQL = {c: f"CASE WHEN {x} IS NULL THEN 0.001e0 ELSE greatest(0.001e0, {x}) END" for c, x in (
    ("ahead", "round_even((0.5e0 + lap_time_delta * 0.1e0) * 1000e0, 0) / 1000e0"),
    ("behind", "round_even((0.8e0 + abs(position_change) * 0.05e0) * 1000e0, 0) / 1000e0"))}


@query("gap_texts", with_ctes(
    ["laps"], f"SELECT row_key, '+' || CAST({_GAPS_SQL['ahead']} AS VARCHAR) || 's' AS ahead, '-' || CAST({_GAPS_SQL['behind']} AS VARCHAR) || 's' AS behind FROM laps"))
def q_gap_texts(spark, sf):
    """the gaps of every lap as text, with their floor (a missing gap reads as the floor)."""
    from pitlane.functions.carstate import gap_text, race_gap_columns
    cols = race_gap_columns()
    return laps(spark, sf).select("row_key", gap_text(cols["gap_ahead"], "+").alias("ahead"), gap_text(cols["gap_behind"], "-").alias("behind"))


@query("lap_events", with_ctes(
    ["laps"], "SELECT row_key, 'LAP ' || CAST(lap_number AS VARCHAR) AS time, 'SIM_LAP_REPLAY' AS event, 'normal' AS type FROM laps"))
def q_lap_events(spark, sf):
    """the event log of every lap, one row an entry."""
    from pitlane.functions.carstate import lap_event_log
    return laps(spark, sf).select("row_key", F.explode(lap_event_log()).alias("e")).select("row_key", "e.time", "e.event", "e.type")


@query("tyre_wear", with_ctes(
    ["laps"], "SELECT row_key, b AS wear_fl, greatest(5, b - 4) AS wear_fr, least(95, b + 6) AS wear_rl, "
              "least(95, b + 5) AS wear_rr FROM (SELECT row_key, "
              "least(95, greatest(5, CAST(trunc(CAST(trunc(tyre_life) AS INTEGER) * 2.5e0) AS INTEGER))) AS b "
              "FROM laps)"))
def q_tyre_wear(spark, sf):
    """F15 on every lap (flat columns)."""
    from pitlane.functions.carstate import tyre_wear_columns
    cols = tyre_wear_columns()
    return laps(spark, sf).select("row_key", *[v.alias(k) for k, v in cols.items()])


@query("leaderboard", with_ctes(
    ["clean"], f"SELECT race, year, lap_number, slot, position, driver, {r('gap_s', 6)} AS gap_s, highlight FROM "
               "(SELECT race, year, lap_number, CAST(slot AS INTEGER) AS slot, position, driver, "
               "lap_time_s - first_value(lap_time_s) OVER (PARTITION BY race, year, lap_number ORDER BY slot) AS gap_s, "
               "driver = 'VER' AS highlight FROM (SELECT *, row_number() OVER (PARTITION BY race, year, lap_number "
               "ORDER BY position, row_key) AS slot FROM clean) WHERE slot <= 5)"))
def q_leaderboard(spark, sf):
    """Top 5 positions per (race, year, lap) with the gap to the leader."""
    from pitlane.operators.feed import leaderboard
    b = leaderboard(cleaned(spark, sf))
    return b.select("race", "year", "lap_number", "slot", "position", "driver", rh("gap_s", 6).alias("gap_s"),
                    "highlight")


@query("trailing_history", with_ctes(
    ["laps"], f"SELECT race, year, driver, lap_number, count(*) OVER w AS n_hist, "
              f"{r('sum(lap_time_s) OVER w', 6)} AS sum_lap_time, {r('coalesce(sum(tyre_life) OVER w, 0e0)', 6)} "
              "AS sum_tyre_life FROM (SELECT race, year, driver, lap_number, "
              "min_by(lap_time_s, row_key) FILTER (WHERE lap_time_s IS NOT NULL) AS lap_time_s, "
              "min_by(tyre_life, row_key) FILTER (WHERE tyre_life IS NOT NULL) AS tyre_life "
              "FROM laps GROUP BY race, year, driver, lap_number) "
              "WINDOW w AS (PARTITION BY race, year, driver ORDER BY lap_number ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))
def q_trailing_history(spark, sf):
    """Trailing 20 laps per (race, year, driver), compared as length and sums of the arrays."""
    from pitlane.operators.feed import trailing_history
    h = trailing_history(laps(spark, sf))
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.coalesce(x["v"], F.lit(0.0)))
    return h.select("race", "year", "driver", "lap_number", F.size("lap_time_history").cast("bigint").alias("n_hist"),
                    rh(add(F.col("lap_time_history")), 6).alias("sum_lap_time"),
                    rh(add(F.col("tyre_life_history")), 6).alias("sum_tyre_life"))


# --------------------------------------------------------------------------- samples and splits


H = hash_sql()


def _sample_sql(src: str, n: int) -> str:
    """The n smallest hashes, as hash_sample takes them."""
    return f"(SELECT * FROM {src} ORDER BY {H}, row_key LIMIT {n})"


DASH_COLS_SQL = ("row_key, CAST(trunc(lap_number) AS INTEGER) AS lap, "
                 "round_even(lap_time_s * 1000e0, 0) / 1000e0 AS laptime_s, "
                 "CAST(trunc(tyre_life) AS INTEGER) AS tyre_life, CAST(trunc(position) AS INTEGER) AS position, "
                 "compound, round_even(ers_risk * 100e0, 0) / 100e0 AS ers_risk, coalesce(ers_status, 'nan') AS ers_status, "
                 "round_even(superclipping_duration * 100e0, 0) / 100e0 AS superclipping_duration, "
                 "round_even(race_progress * 1000e0, 0) / 1000e0 AS race_progress, "
                 "round_even(lap_time_delta * 1000e0, 0) / 1000e0 AS lap_delta")


@query("dashboard_sample", with_ctes(["status"], f"SELECT {DASH_COLS_SQL} FROM {_sample_sql('status', 200)}"))
def q_dashboard_sample(spark, sf):
    """T04 + F25: 200-row reproducible sample, dashboard formatting."""
    return DB.dashboard_sample(scored(spark, sf))


@query("hash_sample", with_ctes(["status"], "SELECT row_key, cumulative_degradation, tyre_life, lap_time_s "
                                            f"FROM {_sample_sql('status', 20000)}"))
def q_hash_sample(spark, sf):
    """The 20,000 rows with the smallest hashes."""
    s = SM.hash_sample(scored(spark, sf), 20000)
    return s.select("row_key", "cumulative_degradation", "tyre_life", "lap_time_s")


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in REGRESSION_FEATURES + [REGRESSION_TARGET])
MATRIX_CTE = f"mx AS (SELECT * FROM enc WHERE {_COMPLETE})"


def _matrix(spark, sf) -> DataFrame:
    return prepared(spark, sf).na.drop(subset=REGRESSION_FEATURES + [REGRESSION_TARGET])


@query("hash_split", with_ctes(["enc"], f"SELECT row_key, {H} < 858993459 AS is_test FROM mx", [MATRIX_CTE]))
def q_hash_split(spark, sf):
    """80/20 split of the complete regression rows by hash threshold (map-only)."""
    return SM.mark_split(_matrix(spark, sf)).select("row_key", "is_test")


@query("exact_split", with_ctes(
    ["enc"], f"SELECT row_key, row_number() OVER (ORDER BY {H}, row_key) <= "
             "CAST(ceil(0.2e0 * (SELECT count(*) FROM mx)) AS BIGINT) AS is_test FROM mx", [MATRIX_CTE]))
def q_exact_split(spark, sf):
    """T07 exact mode: test part of exactly ceil(0.2 n) rows, found by radix selection (no global sort)."""
    return SM.exact_split(_matrix(spark, sf)).select("row_key", "is_test")


STRATIFIED_CTE = (f"strat AS (SELECT *, row_number() OVER (PARTITION BY evento_critico ORDER BY {H}, row_key) <= "
                  "CAST(ceil(0.2e0 * count(*) OVER (PARTITION BY evento_critico)) AS BIGINT) AS is_test FROM ev)")


@query("stratified_split", with_ctes(["status"], "SELECT row_key, evento_critico, is_test FROM strat", [EVENT_CTE, STRATIFIED_CTE]))
def q_stratified_split(spark, sf):
    """Exactly ceil(20 %) of the rows of each class."""
    return SM.mark_stratified(_event_frame(spark, sf), "evento_critico").select("row_key", "evento_critico", "is_test")


CAP_CTES = [EVENT_CTE, STRATIFIED_CTE, "tr AS (SELECT * FROM strat WHERE NOT is_test)",
            "shares AS (SELECT evento_critico, n, tot, 15000 * n // tot AS base, 15000 * n % tot AS rest FROM (SELECT evento_critico, "
            "count(*) AS n, (SELECT count(*) FROM tr) AS tot FROM tr GROUP BY evento_critico))",
            "quota AS (SELECT evento_critico, CASE WHEN tot <= 15000 THEN n ELSE base + CASE WHEN row_number() OVER (ORDER BY rest DESC, "
            "evento_critico) <= 15000 - sum(base) OVER () THEN 1 ELSE 0 END END AS quota FROM shares)"]
CAP_SQL = with_ctes(
    ["status"], "SELECT row_key, evento_critico FROM (SELECT tr.row_key, tr.evento_critico, row_number() OVER "
                f"(PARTITION BY tr.evento_critico ORDER BY {hash_sql('tr.row_key', SM.CAP_SEED)}, tr.row_key) AS rn, "
                "quota.quota FROM tr JOIN quota ON tr.evento_critico = quota.evento_critico) WHERE rn <= quota", CAP_CTES)


@query("stratified_cap", CAP_SQL)
def q_stratified_cap(spark, sf):
    """Cap the training part at exactly 15,000 rows keeping class shares."""
    train, _ = SM.stratified_split(stored(spark, sf, "events", lambda: _event_frame(spark, sf)), "evento_critico")
    return SM.stratified_cap(train, "evento_critico", 15000).select("row_key", "evento_critico")


@query("stratified_cap_exact", CAP_SQL)
def q_stratified_cap_exact(spark, sf):
    """T06 by class: per class its quota of rows, those with the smallest hashes."""
    frame = stored(spark, sf, "events", lambda: _event_frame(spark, sf))
    train, _ = SM.stratified_split(frame, "evento_critico")
    return SM.stratified_cap(train, "evento_critico", 15000).select("row_key", "evento_critico")


@query("model_matrix_regression", with_ctes(
    ["enc"], "SELECT row_key, " + ", ".join(c for c in REGRESSION_FEATURES) +
    f", {r(REGRESSION_TARGET, 9)} AS {REGRESSION_TARGET} FROM mx", [MATRIX_CTE]))
def q_model_matrix_regression(spark, sf):
    """The 12 features and the target on complete rows, with the row key kept."""
    m = _matrix(spark, sf)
    return m.select("row_key", *REGRESSION_FEATURES, rh(REGRESSION_TARGET, 9).alias(REGRESSION_TARGET))


_STD_FEATS = ["cumulative_degradation", "tyre_life", "laptime_normalized"]


@query("standardize", with_ctes(
    ["enc"], "SELECT row_key, " + ", ".join(
        f"{r(f'({c} - (SELECT avg({c}) FROM cm)) / (SELECT stddev_pop({c}) FROM cm)', 6)} AS z_{c}"
        for c in _STD_FEATS) + " FROM cm",
    ["cm AS (SELECT * FROM enc WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _STD_FEATS) + ")"]))
def q_standardize(spark, sf):
    """ML01: (x - mean) / population std of the clustering features (complete rows)."""
    from pitlane.operators.dims import scalar
    m = prepared(spark, sf).na.drop(subset=_STD_FEATS)
    cols = [rh((F.col(c) - scalar(m, F.avg(c))) / scalar(m, F.stddev_pop(c)), 6).alias(f"z_{c}") for c in _STD_FEATS]
    return m.select("row_key", *cols)


# --------------------------------------------------------------------------- profiles, evaluation

PROFILE_SQL = ("prof AS (SELECT compound AS grp, round_even(avg(compound_encoded) * 1e3, 0) / 1e3 AS compound_encoded_mean, "
               "round_even(avg(tyre_life) * 1e2, 0) / 1e2 AS tyre_life_mean, "
               "round_even(avg(laptime_normalized) * 1e4, 0) / 1e4 AS laptime_normalized_mean, "
               "round_even(avg(cumulative_degradation) * 1e3, 0) / 1e3 AS cumulative_degradation_mean, "
               "count(*) AS count FROM enc WHERE cumulative_degradation IS NOT NULL AND tyre_life IS NOT NULL "
               "AND laptime_normalized IS NOT NULL GROUP BY compound)")


def _profiles(spark, sf):
    from pitlane.plans.clusters import cluster_frame, cluster_profiles
    return cluster_profiles(cluster_frame(prepared(spark, sf)).withColumnRenamed("compound", "grp"), "grp")


@query("group_profile", with_ctes(["enc"], "SELECT * FROM prof", [PROFILE_SQL]))
def q_group_profile(spark, sf):
    """A12 over a fixed grouping (compound) so that it has an oracle; the same operator profiles clusters."""
    return _profiles(spark, sf)


def _cluster_label_sql():
    nm = ("coalesce(CASE CAST(round_even(compound_encoded_mean, 0) AS INTEGER) WHEN 0 THEN 'SOFT' WHEN 1 THEN 'MEDIUM' "
          "WHEN 2 THEN 'HARD' WHEN 3 THEN 'INTER' WHEN 4 THEN 'WET' END, 'MIXED')")
    return ("SELECT grp, CASE WHEN cumulative_degradation_mean > 15 AND tyre_life_mean > 25 "
            f"THEN 'Degradación alta (' || {nm} || ')' "
            f"WHEN laptime_normalized_mean < -0.5 THEN 'Ritmo competitivo (' || {nm} || ')' "
            f"WHEN tyre_life_mean < 10 THEN 'Stint temprano (' || {nm} || ')' "
            f"WHEN cumulative_degradation_mean > 8 THEN 'Desgaste moderado (' || {nm} || ')' "
            f"ELSE 'Stint estable (' || {nm} || ')' END AS cluster_label FROM prof")


@query("profile_label", with_ctes(["enc"], _cluster_label_sql(), [PROFILE_SQL]))
def q_profile_label(spark, sf):
    """F17 on the profiles."""
    from pitlane.plans.clusters import profile_labels
    return profile_labels(_profiles(spark, sf), "grp")


# fixed linear rule used as the predictor where a query must be reproducible in SQL
RULE_SQL = "(0.3e0 * cumulative_degradation + 0.05e0 * tyre_life - 1e0)"


def rule_prediction():
    return F.lit(0.3) * F.col("cumulative_degradation") + F.lit(0.05) * F.col("tyre_life") - F.lit(1.0)


TEST_SQL = f"te AS (SELECT *, {RULE_SQL} AS predicted FROM mx WHERE {H} < 858993459)"


def _test_rows(spark, sf):
    _, test = SM.hash_split(_matrix(spark, sf))
    return test.withColumn("predicted", rule_prediction())


@query("regression_metrics", with_ctes(
    ["enc"], f"SELECT {r('avg(abs(laptime_normalized - predicted))', 4)} AS mae, "
             f"{r('avg((laptime_normalized - predicted) * (laptime_normalized - predicted))', 4)} AS mse, "
             f"{r('1e0 - sum((laptime_normalized - predicted) * (laptime_normalized - predicted)) / sum((laptime_normalized - (SELECT avg(laptime_normalized) FROM te)) * (laptime_normalized - (SELECT avg(laptime_normalized) FROM te)))', 4)} AS r2, "
             "count(*) AS n FROM te", [MATRIX_CTE, TEST_SQL]))
def q_regression_metrics(spark, sf):
    """E01 + F26 on the test split (a fixed linear rule is the predictor)."""
    from pitlane.operators.evaluate import regression_metrics
    m = regression_metrics(_test_rows(spark, sf), REGRESSION_TARGET, "predicted")
    return m.select(rh("mae", 4).alias("mae"), rh("mse", 4).alias("mse"), rh("r2", 4).alias("r2"), "n")


@query("real_vs_predicted", with_ctes(
    ["enc"], f"SELECT row_key, {r('laptime_normalized', 9)} AS real, {r('predicted', 9)} AS predicted, "
             f"(SELECT {r('least(min(laptime_normalized), min(predicted))', 9)} FROM te) AS lo, "
             f"(SELECT {r('greatest(max(laptime_normalized), max(predicted))', 9)} FROM te) AS hi FROM te ORDER BY row_key LIMIT 60", [MATRIX_CTE, TEST_SQL]))
def q_real_vs_predicted(spark, sf):
    """The first 60 pairs of the test split in key order, and the ends of the diagonal over all of it."""
    from pitlane.operators.evaluate import real_vs_predicted
    head, diag = real_vs_predicted(_test_rows(spark, sf), REGRESSION_TARGET, "predicted")
    return head.select("row_key", rh("real", 9).alias("real"), rh("predicted", 9).alias("predicted"),
                       rh(diag.select("lo").scalar(), 9).alias("lo"), rh(diag.select("hi").scalar(), 9).alias("hi"))


RESULTS_SQL = (f"SELECT row_key, {r('laptime_normalized', 9)} AS real, {r('predicted', 9)} AS predicted, "
               "lap_time_s AS laptime_s, tyre_life, position, compound, ers_status, superclipping_duration, "
               "coalesce(race, 'Unknown') AS race, lap_number AS lap, race_progress FROM te")


def _results(spark, sf):
    from pitlane.sinks.results import results_projection
    res = results_projection(_test_rows(spark, sf), REGRESSION_TARGET, "predicted")
    return res.withColumn("real", rh("real", 9)).withColumn("predicted", rh("predicted", 9))


@query("results_projection", with_ctes(["enc"], RESULTS_SQL, [MATRIX_CTE, TEST_SQL]))
def q_results_projection(spark, sf):
    """11 result columns of the test rows."""
    return _results(spark, sf)


@query("results_head50", with_ctes(["enc"], f"SELECT * FROM ({RESULTS_SQL}) ORDER BY row_key LIMIT 50",
                                   [MATRIX_CTE, TEST_SQL]))
def q_results_head50(spark, sf):
    """First 50 result rows in key order."""
    from pitlane.sinks.results import results_head
    return results_head(_results(spark, sf))


def _labels(spark, sf):
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf}/labels.parquet")


REPORT_SQL = [
    "lc AS (SELECT label, CAST(sum(sup) AS BIGINT) AS support, sum(prd) AS predicted, sum(tp) AS tp FROM ("
    "SELECT CAST(quality AS VARCHAR) AS label, 1 AS sup, 0 AS prd, CASE WHEN quality = toxic THEN 1 ELSE 0 END AS tp "
    "FROM labels UNION ALL SELECT CAST(toxic AS VARCHAR), 0, 1, 0 FROM labels) GROUP BY label)",
    "per AS (SELECT label, coalesce(tp / nullif(predicted * 1e0, 0e0), 0e0) AS precision, "
    "coalesce(tp / nullif(support * 1e0, 0e0), 0e0) AS recall, support FROM lc)",
    "per2 AS (SELECT *, coalesce(2e0 * precision * recall / nullif(precision + recall, 0e0), 0e0) AS f1 FROM per)",
    "rep AS (SELECT label, precision, recall, f1, support FROM per2 "
    "UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per2 "
    "UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), "
    "sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per2 "
    "UNION ALL SELECT 'accuracy', NULL, NULL, avg(CASE WHEN quality = toxic THEN 1e0 ELSE 0e0 END), count(*) FROM labels)",
]


@query("classification_report", "WITH " + ",\n".join(REPORT_SQL) +
       f"\nSELECT label, {r('precision', 6)} AS precision, {r('recall', 6)} AS recall, {r('f1', 6)} AS f1, "
       "support FROM rep")
def q_classification_report(spark, sf):
    """E02 + E03 over labels: quality is the truth, toxic the prediction."""
    from pitlane.operators.evaluate import classification_report
    rep = classification_report(_labels(spark, sf), "quality", "toxic")
    return rep.select("label", rh("precision", 6).alias("precision"), rh("recall", 6).alias("recall"),
                      rh("f1", 6).alias("f1"), F.col("support").cast("bigint").alias("support"))


@query("confusion_matrix",
       "WITH lab AS (SELECT DISTINCT CAST(quality AS VARCHAR) AS l FROM labels UNION "
       "SELECT DISTINCT CAST(toxic AS VARCHAR) FROM labels), "
       "cnt AS (SELECT CAST(quality AS VARCHAR) AS truth, CAST(toxic AS VARCHAR) AS predicted, count(*) AS n "
       "FROM labels GROUP BY ALL) "
       "SELECT a.l AS truth, b.l AS predicted, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n FROM lab a CROSS JOIN lab b "
       "LEFT JOIN cnt ON cnt.truth = a.l AND cnt.predicted = b.l")
def q_confusion_matrix(spark, sf):
    """All label pairs, zero-filled."""
    from pitlane.operators.evaluate import confusion_matrix
    return confusion_matrix(_labels(spark, sf), "quality", "toxic")


EMB_HASH = hash_sql("CAST(vec_id AS VARCHAR)")
SIL_SQL = (
    f"WITH s AS (SELECT vec_id, label, embedding FROM embeddings ORDER BY {EMB_HASH}, CAST(vec_id AS VARCHAR) LIMIT 20000), "
    "pr AS (SELECT a.vec_id AS i, a.label AS li, b.label AS lj, "
    "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS d "
    "FROM s a JOIN s b ON a.vec_id <> b.vec_id), "
    "pm AS (SELECT i, li, lj, avg(d) AS md FROM pr GROUP BY i, li, lj), "
    "ab AS (SELECT i, max(CASE WHEN li = lj THEN md END) AS a, min(CASE WHEN li <> lj THEN md END) AS b FROM pm GROUP BY i), "
    "sv AS (SELECT s.vec_id, CASE WHEN ab.a IS NULL OR greatest(ab.a, ab.b) = 0 THEN 0e0 "
    "ELSE (ab.b - ab.a) / greatest(ab.a, ab.b) END AS sil FROM s LEFT JOIN ab ON s.vec_id = ab.i) "
    f"SELECT {r('avg(sil)', 6)} AS silhouette, count(*) AS n_points FROM sv")


@query("silhouette_small", SIL_SQL)
def q_silhouette_small(spark, sf):
    """Exact Euclidean silhouette of the embedding labels on all dimensions (a sample of 20,000 points at most,
    which is the operator's feature: all pairwise distances)."""
    from pitlane.operators.evaluate import silhouette
    emb = spark.read.parquet(f"{sf}/embeddings.parquet")
    dims = emb.agg(F.max(F.size("embedding"))).first()[0] or 0
    pts = emb.select(F.col("vec_id").cast("string").alias("row_key"), "label",
                     *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(dims)])
    s = silhouette(pts, [f"x{i}" for i in range(dims)], ["label"], max_points=20000)
    n = pts.select(F.least(F.count(F.lit(1)), F.lit(20000))).scalar()
    return s.select(rh("label", 6).alias("silhouette"), n.alias("n_points"))


@query("scalar_columns", "SELECT vec_id, label FROM embeddings")
def q_scalar_columns(spark, sf):
    """Keep only scalar columns (decided from the schema)."""
    from pitlane.sources.telemetry import scalar_columns
    return scalar_columns(spark.read.parquet(f"{sf}/embeddings.parquet"))


# --------------------------------------------------------------------------- history tables

ISO_SQL = "strftime({c}, '%Y-%m-%dT%H:%M:%S.%f')"


def _events(spark, sf):
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf}/events.parquet")


@query("recent_events", "SELECT event_id, " + ISO_SQL.format(c="ts") + " AS ts, user_id, event_type, value "
       "FROM events ORDER BY events.ts DESC NULLS LAST, event_id LIMIT 10")
def q_recent_events(spark, sf):
    """Ten newest events (TakeOrderedAndProject), timestamps as ISO text."""
    from pitlane.sinks.history import iso_text
    ev = _events(spark, sf)
    top = ev.orderBy(F.col("ts").desc_nulls_last(), "event_id").limit(10)
    return top.select("event_id", iso_text("ts").alias("ts"), "user_id", "event_type", "value")


def _recent_of(spark, rows: DataFrame, name: str) -> DataFrame:
    """History rows appended to their table, and the newest of them read back from it."""
    from pitlane.session import scratch_path
    from pitlane.sinks import history as H
    base = scratch_path(spark, f"history-{uuid.uuid4().hex}")
    H.init_tables(spark, base)
    H.append(rows, base, name, batch_id=0, run_id="query")
    return H.recent_rows(spark, base, name)


@query("recent_alerts",
       "SELECT id, severity, title, description, " + ISO_SQL.format(c="ts") + " AS timestamp FROM "
       "(SELECT md5('event#' || CAST(event_id AS VARCHAR)) AS id, 'CRÍTICO' AS severity, "
       "'EVENT ' || upper(event_type) AS title, coalesce(props, '') AS description, ts FROM events "
       "WHERE event_type = 'error') ORDER BY ts DESC NULLS LAST, id LIMIT 10")
def q_recent_alerts(spark, sf):
    """K07 + S07: alert history built from error events, ten newest."""
    from pitlane.sinks.history import alert_rows_from_events
    return _recent_of(spark, alert_rows_from_events(_events(spark, sf)), "alert_history")


def _pred_sql():
    s = _speed_sql()
    thr = f"greatest(0e0, least(100e0, 55e0 + ({s} - 200e0) * 0.25e0))"
    prog = "(CASE WHEN race_progress IS NULL OR race_progress = 0 THEN 0.5e0 ELSE race_progress END)"

    def rd(x):
        return f"round_even(({x}) * 10e0, 0) / 10e0"
    return (
        "SELECT id, predicted_laptime, status, velocidad, soc_bateria, mguk_kw, throttle_pct, aero_mode, temp_bateria, "
        + ISO_SQL.format(c="ts") + " AS timestamp FROM ("
        f"SELECT md5('sample#' || CAST(sample_id AS VARCHAR)) AS id, {live_duration_sql()} AS predicted_laptime, "
        f"{live_status_sql(live_duration_sql())} AS status, {rd(s)} AS velocidad, "
        f"{rd(f'greatest(30e0, 85e0 - {prog} * 40e0)')} AS soc_bateria, {rd(f'280e0 + {thr} * 0.8e0')} AS mguk_kw, "
        f"{rd(thr)} AS throttle_pct, CASE WHEN {s} > 250e0 THEN 'STRAIGHT MODE' ELSE 'CORNER MODE' END AS aero_mode, "
        f"{rd('38e0 + tyre_life * 0.4e0')} AS temp_bateria, ts FROM "
        "(SELECT t.speed_fl, t.speed_st, t.sample_id, t.ts, f.race_progress, f.tyre_life, f.normalized_tyre_life, "
        "f.lap_time_delta FROM telemetry t JOIN fpl f USING (lap_number) "
        "WHERE t.team = 'Red Bull Racing' AND t.driver = 'VER')) ORDER BY timestamp DESC, id LIMIT 10")


@query("recent_predictions", with_ctes(["laps", "telemetry"], _pred_sql(), FEED_SQL + [FIRST_SQL]))
def q_recent_predictions(spark, sf):
    """K06 + S07: one superclipping prediction per telemetry sample of the feed; ten newest."""
    from pitlane.operators import feed as FD
    from pitlane.sinks.history import prediction_rows
    from pitlane.sources.telemetry import telemetry_from_testdata
    feed = FD.build_feed(laps(spark, sf), None)
    samples = telemetry_from_testdata(spark, sf, with_time=True).filter(
        (F.col("team") == "Red Bull Racing") & (F.col("driver") == "VER"))
    return _recent_of(spark, prediction_rows(feed, samples), "superclipping_predictions")


# --------------------------------------------------------------------------- registry and long metrics

def _reg_sql():
    reg = ORACLE["regression_metrics"]
    rep = "WITH " + ",\n".join(REPORT_SQL) + "\n"
    return (
        f"SELECT 'regression' AS model, 'local' AS source, 'r2' AS metric_name, {r('r2', 4)} AS metric FROM ({reg}) "
        f"UNION ALL SELECT 'decision_tree', 'local', 'accuracy', {r('f1', 4)} FROM ({rep} SELECT f1 FROM rep "
        "WHERE label = 'accuracy') "
        f"UNION ALL SELECT 'kmeans', 'local', 'silhouette_score', {r('silhouette', 4)} FROM ({SIL_SQL}) "
        f"UNION ALL SELECT 'svm', 'local', 'best_recall', {r('recall', 4)} FROM ({rep} SELECT recall FROM rep "
        "WHERE label = '1')")


@query("registry_union", _reg_sql())
def q_registry_union(spark, sf):
    """One provenance row per model family, each from its own metric document."""
    from pitlane.plans.registry import provenance_union
    docs = {
        "regression": q_regression_metrics(spark, sf).select(F.col("r2")),
        "decision_tree": q_classification_report(spark, sf).filter(F.col("label") == "accuracy")
                                                              .select(F.col("f1").alias("accuracy")),
        "kmeans": q_silhouette_small(spark, sf).select(F.col("silhouette").alias("silhouette_score")),
        "svm": q_classification_report(spark, sf).filter(F.col("label") == "1")
                                                   .select(F.col("recall").alias("best_recall")),
    }
    u = provenance_union(docs)
    return u.select("model", "source", "metric_name", rh("metric", 4).alias("metric"))


@query("metrics_long",
       "WITH " + ",\n".join(REPORT_SQL) + "\nSELECT 'local' AS run_id, 'metric' AS kind, "
       "CASE WHEN label = 'accuracy' THEN 'dt_accuracy' ELSE 'dt_f1_' || replace(replace(label, ' ', '_'), 'Í', 'I') END "
       f"AS name, {r('f1', 6)} AS value FROM rep UNION ALL "
       "SELECT 'local', 'param', 'n_rows', CAST(count(*) AS DOUBLE) FROM labels")
def q_metrics_long(spark, sf):
    """K14 + F20: metrics and parameters flattened to (run, kind, name, value) rows."""
    from pitlane.plans.registry import metrics_long
    rep = q_classification_report(spark, sf)
    n = _labels(spark, sf).agg(F.count(F.lit(1)).cast("double").alias("n_rows"))
    return metrics_long(rep, n, run_id="local")


@query("provenance_resolved",
       f"SELECT model, CASE WHEN model IN ('regression', 'svm') THEN 'consolidated' ELSE 'local' END AS source, metric FROM ({_reg_sql()})")
def q_provenance_resolved(spark, sf):
    """Provenance read from written documents; the consolidated registry goes before a model's own document."""
    from pitlane.plans.registry import METRIC_FIELD, provenance
    from pitlane.session import scratch_path
    from pitlane.sinks.results import write_json_document
    base = scratch_path(spark, f"provenance-{uuid.uuid4().hex}")
    metric = {r["model"]: r["metric"] for r in q_registry_union(spark, sf).collect()}  # one row a model
    for model, value in metric.items():
        write_json_document(spark, {"training_source": "local", METRIC_FIELD[model]: value}, f"{base}/ml/metrics_{model}")
    write_json_document(spark, {m: {"source": "consolidated", "metric": metric[m]} for m in ("regression", "svm")}, f"{base}/ml/models_source")
    return provenance(spark, base).select("model", "source", rh("metric", 4).alias("metric"))


# --------------------------------------------------------------------------- model steps with fixed parameters

CENTRES = [[-2.0, 10.0], [8.0, 30.0], [20.0, 5.0]]


@query("kmeans_assign", with_ctes(["clean"], "SELECT row_key, CAST(CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS INTEGER) AS cluster FROM "
       "(SELECT row_key, " + ", ".join(f"(cumulative_degradation - {a}e0) * (cumulative_degradation - {a}e0) + (tyre_life - {b}e0) * (tyre_life - {b}e0) AS d{i}"
                                       for i, (a, b) in enumerate(CENTRES)).replace("- -", "+ ") + " FROM clean)"))
def q_kmeans_assign(spark, sf):
    """ML05: assignment to fixed centres (the fitted model's own code path)."""
    from pyspark.ml.feature import VectorAssembler
    from pitlane.plans.clusters import Centroids
    x = VectorAssembler(inputCols=["cumulative_degradation", "tyre_life"], outputCol="features").transform(cleaned(spark, sf))
    return Centroids(CENTRES).transform(x).select("row_key", "cluster")


@query("fourier_features", with_ctes(["clean"], "SELECT row_key, " + ", ".join(
    f"{r(f'cos({b}e0 + lap_time_delta * {w[0]}e0 + race_progress * {w[1]}e0) * sqrt(2e0 / 2e0)', 6)} AS rff_{k}"
    for k, (w, b) in enumerate((((0.25, 1.5), 0.3), ((0.75, 0.5), 2.0)))) + " FROM clean"))
def q_fourier_features(spark, sf):
    """ML09: the random feature map with fixed weights."""
    from pitlane.plans.safety import FourierMap
    cols = FourierMap([[0.25, 1.5], [0.75, 0.5]], [0.3, 2.0]).columns(["lap_time_delta", "race_progress"])
    return cleaned(spark, sf).select("row_key", *cols).select("row_key", *[rh(f"rff_{k}", 6).alias(f"rff_{k}") for k in range(2)])


@query("least_squares_one", with_ctes(["clean"], f"SELECT {r('regr_slope(lap_time_s, tyre_life)', 6)} AS slope, "
                                                 f"{r('regr_intercept(lap_time_s, tyre_life)', 6)} AS intercept, count(*) AS n FROM clean"))
def q_least_squares_one(spark, sf):
    """ML02: the least-squares fit of one feature on all cleaned laps."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    x = VectorAssembler(inputCols=["tyre_life"], outputCol="features").transform(cleaned(spark, sf))
    m = LinearRegression(featuresCol="features", labelCol="lap_time_s", regParam=0.0, solver="normal", standardization=False).fit(x)
    return cleaned(spark, sf).agg(rh(F.lit(float(m.coefficients[0])), 6).alias("slope"), rh(F.lit(float(m.intercept)), 6).alias("intercept"),
                                  F.count(F.lit(1)).alias("n"))
