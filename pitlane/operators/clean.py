"""Cleaning, encoding and derived lap fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlane import schemas as S
from pitlane.functions import lookup, risk
from pitlane.operators.dims import checked_dim, materialize, scalar


#: Value ranges a counting pass splits each group's range into.
QUANTILE_BUCKETS = 4096
#: Open ranks up to which the ranges of a counting pass are kept on the driver; beyond, they are a written table.
MAX_DRIVER_STATE = 20_000


def quantiles(df: DataFrame, c: str, qs, keys: list[str] | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles of `c` (per `keys` group), as column `q` (a double, or an array for a list).

    The wanted ranks are found by counting value ranges: every pass splits the range that still holds a rank into
    QUANTILE_BUCKETS parts of equal width, counts them with partial aggregation and goes on with the part that
    holds the rank, until a rank is the least, the largest or the only value of its part. So no task ever holds a
    column's values, only counts: at most QUANTILE_BUCKETS a range, whatever the group's size or its number of
    distinct values. A trillion rows take four passes; the passes after the first read few rows.
    Groups without a value are left out; with no group and no value there is no row.
    """
    keys = list(keys or [])
    many = isinstance(qs, (list, tuple))
    wanted = [float(x) for x in (qs if many else [qs])]
    group = F.to_json(F.struct(*keys)) if keys else F.lit("all")  # a text of the key in which nulls equal each other
    rows = df.filter(F.col(c).isNotNull()).select(group.alias("_g"), *keys, F.col(c).cast("double").alias("_v"))
    groups = materialize(rows.groupBy("_g").agg(*[F.first(k, ignorenulls=True).alias(k) for k in keys], F.count(F.lit(1)).alias("_n"),
                                                F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    place = [F.lit(x) * (F.col("_n") - 1) for x in wanted]
    ranks = F.array_distinct(F.concat(*[F.array(F.floor(x), F.ceil(x)) for x in place]))
    state = groups.select("_g", F.explode(ranks).alias("_rank"), F.col("_n").alias("_of"), "_lo", "_hi").withColumn("_left", F.col("_rank"))
    first = state.limit(MAX_DRIVER_STATE + 1).collect()
    values = _ranks_small(rows, state.schema, first) if len(first) <= MAX_DRIVER_STATE else _ranks_large(rows, state)
    at = values.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))
    each = [F.col("_at")[F.floor(x)] + (x - F.floor(x)) * (F.col("_at")[F.ceil(x)] - F.col("_at")[F.floor(x)]) for x in place]
    return groups.join(F.broadcast(at) if len(first) <= MAX_DRIVER_STATE else at, "_g").select(*keys, (F.array(*each) if many else each[0]).alias("q"))


FOUND = "_g string, _rank bigint, _value double"


def _ranks_small(rows: DataFrame, schema, state: list) -> DataFrame:
    """The values at a few ranks: one counting job a pass, the ranges still open kept on the driver (MAX_DRIVER_STATE
    at most)."""
    spark, found = rows.sparkSession, []
    while state:
        open_ = []
        for r in state:
            if r["_left"] == 0 or r["_lo"] == r["_hi"]:
                found.append((r["_g"], r["_rank"], r["_lo"]))
            elif r["_left"] == r["_of"] - 1:
                found.append((r["_g"], r["_rank"], r["_hi"]))
            else:
                open_.append(r)
        state = _narrowed(rows, spark.createDataFrame(open_, schema), small=True).collect() if open_ else []
    return spark.createDataFrame(found, FOUND)


def _ranks_large(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The values at ranks of any number of groups: the ranges still open are a written table."""
    found = None
    while True:
        value = (F.when((F.col("_left") == 0) | (F.col("_lo") == F.col("_hi")), F.col("_lo"))
                 .when(F.col("_left") == F.col("_of") - 1, F.col("_hi")))
        state = state.withColumn("_value", value)
        done = state.filter(F.col("_value").isNotNull()).select("_g", "_rank", "_value")
        found = done if found is None else found.unionByName(done)
        open_ = state.filter(F.col("_value").isNull())
        if open_.isEmpty():
            return found
        state = materialize(_narrowed(rows, open_, small=False))


def _narrowed(rows: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """One counting pass: for each open rank the part of its range that holds it."""
    ranges = state.select("_g", "_lo", "_hi").distinct()
    ranges = F.broadcast(ranges) if small else checked_dim(ranges)
    inside = rows.select("_g", "_v").join(ranges, "_g").filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    part = F.least(F.lit(QUANTILE_BUCKETS - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * QUANTILE_BUCKETS))
    counts = inside.groupBy("_g", "_lo", "_hi", part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    before = Window.partitionBy("_g", "_lo", "_hi").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    hit = (F.col("_left") >= F.col("_before")) & (F.col("_left") < F.col("_before") + F.col("_c"))
    wanted = state.select("_g", "_lo", "_hi", "_rank", "_left")
    return (counts.join(F.broadcast(wanted) if small else wanted, ["_g", "_lo", "_hi"]).filter(hit)
            .select("_g", "_rank", F.col("_c").alias("_of"), F.col("_low").alias("_lo"), F.col("_high").alias("_hi"),
                    (F.col("_left") - F.col("_before")).alias("_left")))


def global_quantile(df: DataFrame, c: str, qs) -> Column:
    """Scalar-subquery form of `quantiles` over all rows."""
    return quantiles(df, c, qs).select("q").scalar()


def drop_incomplete(laps: DataFrame, subset=None) -> DataFrame:
    """Drop laps missing any key column (null; NaN was turned into null at the source)."""
    return laps.na.drop(subset=list(subset or S.CLEAN_KEYS))


def drop_incomplete_mark(subset=None) -> Column:
    """P01 as a condition."""
    names = list(subset or S.CLEAN_KEYS)
    mark = F.col(names[0]).isNotNull()
    for name in names[1:]:
        mark = mark & F.col(name).isNotNull()
    return mark


def laptime_stats(df: DataFrame) -> DataFrame:
    """Global median and sample standard deviation of the lap time (one row)."""
    return df.agg(F.stddev_samp("lap_time_s").alias("std_s")).select(
        global_quantile(df, "lap_time_s", 0.5).alias("median_s"), "std_s")


def trim_threshold(df: DataFrame) -> Column:
    """median + 2*stddev_samp of the lap time (two scalar subqueries over `df`)."""
    return global_quantile(df, "lap_time_s", 0.5) + F.lit(2.0) * scalar(df, F.stddev_samp("lap_time_s"))


def trim_outliers(df: DataFrame, limit: Column | None = None) -> DataFrame:
    """Keep lap_time < median + 2*std (strict, upper side only). One row -> no std -> nothing kept. limit: the
    threshold of these rows, if it is known."""
    return df.filter(F.col("lap_time_s") < (trim_threshold(df) if limit is None else limit))


def position_range(df: DataFrame) -> DataFrame:
    """Inclusive 1..20."""
    return df.filter(F.col("position").between(1, 20))


def positive_laptime(df: DataFrame) -> DataFrame:
    """P04."""
    return df.filter(F.col("lap_time_s") > 0)


def clean_rows(laps: DataFrame, limit: Column | None = None) -> DataFrame:
    """P01 -> P02 (statistics after P01, or the threshold they gave) -> P03 -> P04."""
    return positive_laptime(position_range(trim_outliers(drop_incomplete(laps), limit)))


def race_medians(df: DataFrame) -> DataFrame:
    """Median lap time per race; races pooled across years; the null race is its own group."""
    return quantiles(df, "lap_time_s", 0.5, ["race"]).select(
        "race", F.col("q").cast("double").alias("laptime_baseline"))


def race_text(c="race") -> Column:
    """Race as text for encoding; missing is the text 'nan'."""
    return F.coalesce(F.col(c), F.lit("nan"))


def race_dimension(rows: DataFrame) -> DataFrame:
    """One small dimension for J02 and W01: per race its median lap time and its code.

    A02 groups the rows by race (partial aggregation, so a hot race is never
    collected in one task); the zero-based alphabetical code of the race text
    is a row number over this dimension (tens of rows), so the window without a
    partition key never sees lap rows. The null race keeps no baseline (a null
    key finds no group in the reference either) but gets the code of 'nan'.
    """
    g = race_medians(rows)
    g = g.withColumn("laptime_baseline", F.when(F.col("race").isNotNull(), F.col("laptime_baseline")))
    g = g.withColumn("race_text", race_text())
    return g.withColumn("race_encoded", (F.dense_rank().over(Window.orderBy("race_text")) - 1).cast("int"))


def _join_race_dim(df: DataFrame, dim: DataFrame, cols: list[str]) -> DataFrame:
    d = checked_dim(dim.select(F.col("race").alias("_dim_race"), *cols))
    return df.join(d, df["race"].eqNullSafe(d["_dim_race"]), "left").drop("_dim_race")


def attach_race_baseline(df: DataFrame) -> DataFrame:
    """J02 + F10: attach the race median; a null race gets no baseline."""
    out = _join_race_dim(df, race_dimension(df), ["laptime_baseline"])
    return out.withColumn("laptime_normalized", F.col("lap_time_s") - F.col("laptime_baseline"))


def attach_race_code(df: DataFrame) -> DataFrame:
    """The code needs the distinct races only, no medians."""
    names = df.select("race").distinct().withColumn("race_text", race_text())
    dim = names.withColumn("race_encoded", (F.dense_rank().over(Window.orderBy("race_text")) - 1).cast("int"))
    return _join_race_dim(df, dim, ["race_encoded"])


def year_offset_base(rows: DataFrame) -> Column:
    return scalar(rows, F.min(F.col("year").cast("int")))


def attach_year_offset(df: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """year - min(year) over all rows (scalar subquery over `rows`, default `df`).

    A missing year after cleaning is an error (the integer cast of the analysed
    pipeline fails on it); it is raised inside the job, without an extra pass.
    """
    y0 = year_offset_base(rows if rows is not None else df)
    offset = (F.col("year").cast("int") - y0).cast("int")
    return df.withColumn("year_encoded", F.when(F.col("year").isNull(), F.raise_error(
        F.lit("missing year after cleaning")).cast("int")).otherwise(offset))


def encode(rows: DataFrame) -> DataFrame:
    """F09, J02/F10, W01, F11 on cleaned rows: one dimension join, one merged scalar subquery."""
    out = rows.withColumn("compound_encoded", lookup.compound_code())
    out = _join_race_dim(out, race_dimension(rows), ["laptime_baseline", "race_encoded"])
    out = out.withColumn("laptime_normalized", F.col("lap_time_s") - F.col("laptime_baseline"))
    return attach_year_offset(out, rows)


def ers_bounds(df: DataFrame) -> tuple[Column, Column]:
    """Global min and max of the raw risk as scalar subqueries (merged into one job)."""
    raw = risk.ers_raw()
    return scalar(df, F.min(raw)), scalar(df, F.max(raw))


def dashboard_fields(df: DataFrame, bounds: tuple | None = None) -> DataFrame:
    """Raw risk, risk scaled to 0..10 over all rows, status, duration.

    `bounds` may carry fixed (min, max) values, e.g. those saved with a model for streaming.
    """
    lo, hi = bounds if bounds is not None else ers_bounds(df)
    lo = F.lit(lo) if isinstance(lo, (int, float)) else lo
    hi = F.lit(hi) if isinstance(hi, (int, float)) else hi
    out = df.withColumn("ers_risk", risk.ers_scaled(risk.ers_raw(), lo, hi))
    out = out.withColumn("ers_status", risk.ers_status("ers_risk"))
    return out.withColumn("superclipping_duration", risk.superclip_duration("ers_risk"))


def prepare(laps: DataFrame, encode_features: bool = True) -> DataFrame:
    """Full training frame: clean rows, encodings and dashboard fields."""
    return prepare_clean(clean_rows(laps), encode_features)


def prepare_clean(rows: DataFrame, encode_features: bool = True) -> DataFrame:
    """The training frame of cleaned rows (best a stored table: its statistics read it again).

    Every global statistic (year offset, risk bounds) is a scalar subquery over
    the same cleaned rows, so Catalyst merges them into one aggregate job.
    """
    out = encode(rows) if encode_features else rows
    return dashboard_fields(out, ers_bounds(rows))


def row_accounting(laps: DataFrame) -> DataFrame:
    """Raw, kept, removed and complete-regression-row counts in one row: one aggregate that marks each lap,
    after the pass for the trim threshold."""
    complete = drop_incomplete_mark() & (F.col("lap_time_s") < trim_threshold(drop_incomplete(laps)))
    kept = F.coalesce(complete & F.col("position").between(1, 20) & (F.col("lap_time_s") > 0), F.lit(False))
    full = kept & F.col("position_change").isNotNull() & F.col("prev_tyre_life").isNotNull() & F.col("pit_stop").isNotNull() & F.col("race").isNotNull()
    return laps.agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(kept).alias("n_clean"), F.count_if(full).alias("n_complete")).withColumn(
        "n_removed", F.col("n_raw") - F.col("n_clean"))
