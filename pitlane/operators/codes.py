"""Race codes that stay (W01 across runs): a versioned dictionary that grows without moving what it has.

The codes of a first table are those of W01 (order of the race texts). A later table's new races get the next numbers, in
order of their texts, under the next version; a model keeps the version that it was trained with, so that rows of races it
has never seen can be told apart when they are scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlane.operators.clean import race_text
from pitlane.operators.dims import checked_dim, materialize


def extend_codes(known: DataFrame | None, rows: DataFrame) -> DataFrame:
    """(race_text, race_encoded, version) of known and of the races in rows that it lacks, written. Only the distinct races
    are numbered (one row each). A missing race is the text 'nan'."""
    races = rows.select(race_text().alias("race_text")).distinct()
    if known is None:
        last, version = -1, 0
    else:
        top = known.agg(F.max("race_encoded").alias("c"), F.max("version").alias("v")).first()
        last, version = (top["c"] if top["c"] is not None else -1), top["v"] or 0
        races = races.join(known, "race_text", "left_anti")
    number = F.row_number().over(Window.orderBy("race_text")) + last
    new = races.select("race_text", number.cast("int").alias("race_encoded"), F.lit(version + 1).alias("version"))
    return materialize(new if known is None else known.select(*new.columns).unionByName(new))


def attach_codes(rows: DataFrame, codes: DataFrame, trained_version: int) -> DataFrame:
    """rows with race_encoded, and race_unseen: whether the race is newer than the version a model was trained with."""
    dim = checked_dim(codes.select(F.col("race_text").alias("_text"), "race_encoded", (F.col("version") > trained_version).alias("race_unseen")))
    return rows.drop("race_encoded", "race_unseen").join(dim, race_text() == F.col("_text"), "left").drop("_text")
