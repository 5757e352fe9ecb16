"""Lap sources (S01, S08) and the adapter that derives laps from the shared test tables."""

from __future__ import annotations

import hashlib
import os
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane import constants as C
from pitlane import schemas as S
from pitlane.operators.dims import materialize
from pitlane.session import path_bytes, path_exists, scratch_path

#: Bytes and rows of lineitem that go to one part of the join that derives laps at most, and parts (by bytes) from which on a
#: table is large. Sorts hold rows, whatever their files compress to.
PART_BYTES, PART_ROWS, MANY_PARTS = 16 << 20, 1 << 19, 8


def _numeric_nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column; null spellings become null in text columns."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
        elif isinstance(f.dataType, T.StringType) and f.name != "row_key":
            out.append(F.when(F.trim(c).isin(C.NULL_STRINGS), F.lit(None).cast("string"))
                       .otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(out)


def row_key_of(cols: list[Column]) -> Column:
    """Stable row identity: md5 over the columns' texts, each with its length in front and nulls as 'n', so that
    different rows have different texts. Laps that are equal in all of these columns share a key."""
    part = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("n")) for c in cols]
    return F.md5(F.concat_ws("|", *part))


def read_laps_csv(spark: SparkSession, path: str) -> DataFrame:
    """Lap CSV with header and a fixed schema; columns renamed to snake case once."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"missing lap file: {path}")
    raw = (spark.read.schema(S.LAPS_CSV).option("header", True)
           .option("mode", "PERMISSIVE").option("nanValue", "NaN").csv(path))
    renamed = raw.select([F.col(f"`{h}`").alias(n) for h, n, _ in S.LAP_COLUMNS])
    return normalize_laps(renamed)


def split_laps_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S01 with nothing lost: (laps, bad records) of a lap CSV with header, from one parse written to the shared folder.

    A record is bad if it has another number of fields than the header, or a field that neither names a missing value nor
    reads as its column's type; bad records come as (file, record, problem). Every record is in one of the two."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"missing lap file: {path}")
    texts = T.StructType([*(T.StructField(h, T.StringType()) for h, _, _ in S.LAP_COLUMNS), T.StructField("_record", T.StringType())])
    raw = (spark.read.schema(texts).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_record")
           .option("nullValue", "\u0000").csv(path))
    values, wrong = [], []
    for h, n, t in S.LAP_COLUMNS:
        text = F.trim(F.col(f"`{h}`"))
        known = F.when(~text.isin(C.NULL_STRINGS), F.col(f"`{h}`") if isinstance(t, T.StringType) else text)
        number = known.try_cast("double")
        value = known if isinstance(t, T.StringType) else number if isinstance(t, T.DoubleType) else F.when(number == F.floor(number), number.try_cast(t))
        values.append(value.alias(n))
        wrong.append(F.when(known.isNotNull() & value.isNull(), F.lit(n)))
    names = F.array_compact(F.array(*wrong))
    problem = F.when(F.col("_record").isNotNull(), F.lit("number of fields")).when(F.size(names) > 0, F.array_join(names, ","))
    record = F.coalesce("_record", F.concat_ws(",", *(F.coalesce(f"`{h}`", F.lit("")) for h, _, _ in S.LAP_COLUMNS)))
    parsed = materialize(raw.select(*values, F.col("_metadata.file_path").alias("file"), record.alias("record"), problem.alias("problem")))
    good = parsed.where("problem is null").drop("file", "record", "problem")
    return normalize_laps(good), parsed.where("problem is not null").select("file", "record", "problem")


def read_laps_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Laps from foreign Parquet with internal names: normalised on read (null rules, row key)."""
    df = spark.read.parquet(path)
    return normalize_laps(df)


def write_lap_table(laps: DataFrame, path: str) -> None:
    """Store laps normalised, partitioned by year: reads then need no per-row rules and keep pushdown.

    Rows are sorted by (year, driver, race) inside each task (no extra shuffle): one open file per
    task at a time, and Parquet row-group statistics become selective for driver/race filters.
    """
    (normalize_laps(laps).sortWithinPartitions("year", "driver", "race")
     .write.mode("overwrite").partitionBy("year").parquet(path))


def read_lap_table(spark: SparkSession, path: str) -> DataFrame:
    """A lap table written by write_lap_table: fixed schema, no expressions on read, so driver,
    race and lap filters reach the Parquet reader and year filters prune partitions."""
    return spark.read.schema(S.LAPS).parquet(path)


def normalize_laps(df: DataFrame) -> DataFrame:
    """Apply the null rules and attach a row key when the source has none."""
    names = [n for _, n, _ in S.LAP_COLUMNS]
    if "row_key" not in df.columns:
        df = df.withColumn("row_key", row_key_of([F.col(n) for n in names]))
    return _numeric_nan_to_null(df.select("row_key", *names))


def laps_from_testdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lap table derived from lineitem, orders, customer and nation.

    The mapping is fixed (see FIXTURES.md section 2.1) so that Spark and the SQL
    oracle derive the same laps. Joins of small tables: lineitem-orders, -customer
    and -nation, broadcast. Of large ones first the small sides, orders-customer
    on the customer key and customer-nation (tiny), then lineitem with them on
    the order key, so that the rows of lineitem are shuffled once, whatever the
    size of customer, in parts of PART_BYTES and PART_ROWS at most, whose sorts
    stay in memory.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")

    parts = -(-path_bytes(spark, f"{sf_dir}/lineitem.parquet") // PART_BYTES)
    if parts >= MANY_PARTS:
        place = (orders.join(cust, orders.o_custkey == cust.c_custkey)
                 .join(nation, F.col("c_nationkey") == nation.n_nationkey).select("o_orderkey", "o_orderdate", "n_name"))
        parts = max(parts, -(-li.count() // PART_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
        j = li.repartition(parts, "l_orderkey").join(place.repartition(parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    else:
        j = (li.join(orders, li.l_orderkey == orders.o_orderkey)
             .join(cust, F.col("o_custkey") == cust.c_custkey)
             .join(nation, F.col("c_nationkey") == nation.n_nationkey))

    sk20 = F.col("l_suppkey") % 20
    lap = (F.col("l_orderkey") % 78 + 1).cast("int")
    compound = (F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "SOFT")
                .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), "MEDIUM")
                .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), "HARD")
                .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "INTERMEDIATE")
                .when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "WET")
                .when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "HYPERSOFT"))
    price_time = F.lit(70.0) + F.col("l_extendedprice") / F.lit(2000.0)
    return j.select(
        row_key_of([F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
                    F.col("l_quantity").cast("int"),
                    F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("bigint")]).alias("row_key"),
        F.when(sk20 == 1, F.lit("VER")).otherwise(F.concat(F.lit("D"), sk20.cast("string"))).alias("driver"),
        F.when(F.col("n_name") == "NATION_24", F.lit(None).cast("string"))
         .when(F.col("n_name") == "NATION_6", F.lit("Monaco Grand Prix"))
         .otherwise(F.concat(F.col("n_name"), F.lit(" Grand Prix"))).alias("race"),
        F.year("o_orderdate").cast("int").alias("year"),
        lap.alias("lap_number"),
        F.col("l_linenumber").cast("int").alias("stint"),
        (F.col("l_suppkey") % 22).cast("int").alias("position"),
        F.when(F.col("l_partkey") % 97 == 0, price_time * 3).otherwise(price_time).alias("lap_time_s"),
        F.when(F.col("l_partkey") % 89 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("l_quantity")).alias("tyre_life"),
        compound.alias("compound"),
        ((F.col("l_extendedprice") - 53000.0) / 7500.0).alias("lap_time_delta"),
        (F.col("l_quantity") / 50.0).alias("normalized_tyre_life"),
        (lap / 78.0).alias("race_progress"),
        (F.col("l_discount") * 200.0 - F.col("l_linenumber")).alias("cumulative_degradation"),
        F.when(F.col("l_linenumber") == 1, F.lit(None).cast("double"))
         .otherwise((F.col("l_suppkey") % 5 - 2).cast("double")).alias("position_change"),
        F.when(F.col("l_quantity") == 1, F.lit(None).cast("double"))
         .otherwise(F.col("l_quantity") - 1).alias("prev_tyre_life"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("pit_stop"),
    )


# DuckDB form of the same derivation, used by the SQL oracle.
LAPS_SQL = """
laps AS (
  SELECT
    md5(array_to_string(list_transform([CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
        CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
        CAST(CAST(l_quantity AS INTEGER) AS VARCHAR),
        CAST(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS VARCHAR)],
        lambda x: coalesce(length(x) || ':' || x, 'n')), '|')) AS row_key,
    CASE WHEN l_suppkey % 20 = 1 THEN 'VER' ELSE 'D' || CAST(l_suppkey % 20 AS VARCHAR) END AS driver,
    CASE WHEN n_name = 'NATION_24' THEN NULL
         WHEN n_name = 'NATION_6' THEN 'Monaco Grand Prix'
         ELSE n_name || ' Grand Prix' END AS race,
    CAST(year(o_orderdate) AS INTEGER) AS year,
    CAST(l_orderkey % 78 + 1 AS INTEGER) AS lap_number,
    CAST(l_linenumber AS INTEGER) AS stint,
    CAST(l_suppkey % 22 AS INTEGER) AS position,
    CASE WHEN l_partkey % 97 = 0 THEN (70e0 + l_extendedprice / 2000e0) * 3
         ELSE 70e0 + l_extendedprice / 2000e0 END AS lap_time_s,
    CASE WHEN l_partkey % 89 = 0 THEN NULL ELSE l_quantity END AS tyre_life,
    CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'SOFT'
         WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'MEDIUM'
         WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'HARD'
         WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'INTERMEDIATE'
         WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'WET'
         WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'HYPERSOFT' END AS compound,
    (l_extendedprice - 53000e0) / 7500e0 AS lap_time_delta,
    l_quantity / 50e0 AS normalized_tyre_life,
    CAST(l_orderkey % 78 + 1 AS INTEGER) / 78e0 AS race_progress,
    l_discount * 200e0 - l_linenumber AS cumulative_degradation,
    CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_suppkey % 5 - 2 AS DOUBLE) END AS position_change,
    CASE WHEN l_quantity = 1 THEN NULL ELSE l_quantity - 1 END AS prev_tyre_life,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS pit_stop
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
)"""


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """An empty selection is an error (one cheap action that stops at the first row)."""
    if df.isEmpty():
        raise ValueError(f"no rows for {what}")
    return df


_LAP_TABLES: dict[tuple[str, str], str] = {}
_LAP_LOCK = threading.Lock()


def testdata_lap_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived lap table stored as Parquet partitioned by year, as laps are kept in production.

    The derivation (three joins over the shared tables) runs once per
    application and input folder; the table goes to the shared checkpoint
    folder (never a machine-local folder) and every query then scans it with
    partition pruning, column pruning and pushed-down filters.
    """
    return read_lap_table(spark, lap_table_path(spark, sf_dir))


def lap_table_path(spark: SparkSession, sf_dir: str) -> str:
    """Where the derived lap table of an input folder is stored; it is written at the first call."""
    key = (spark.sparkContext.applicationId, sf_dir if "://" in sf_dir else os.path.abspath(sf_dir))
    with _LAP_LOCK:
        path = _LAP_TABLES.get(key)
        if path is None:
            tag = hashlib.md5("|".join(key).encode()).hexdigest()[:16]
            path = scratch_path(spark, f"laps-{tag}")
            write_lap_table(laps_from_testdata(spark, sf_dir), path)
            _LAP_TABLES[key] = path
    return path
