"""The ordered live feed: files in any order, late ones, replays and restarts give what a batch over all rows gives."""

from pyspark.sql import functions as F

from pitlane import schemas as S
from pitlane.operators.feed import trailing_history
from pitlane.streaming import lap_stream as LS


def some_laps(spark, sf):
    from pitlane.plans.catalog import laps
    lp = laps(spark, sf).select(*[f.name for f in S.LAPS.fields])
    again = lp.where("crc32(cast(row_key as binary)) % 9 = 0").withColumns({"row_key": F.concat(F.lit("a"), "row_key"), "position": F.lit(7)})
    gaps = lp.where("crc32(cast(row_key as binary)) % 7 = 0").withColumns({"row_key": F.concat(F.lit("0"), "row_key"), "position": F.lit(None).cast("int")})
    return lp.unionByName(again, True).unionByName(gaps, True)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_any_order_late_files_and_restart(spark, sf_small, tmp_path):
    lp = some_laps(spark, sf_small).withColumn("part", F.abs(F.hash("row_key")) % 6)
    base = str(tmp_path)
    parts = [lp.where(F.col("part") == i).drop("part") for i in range(6)]

    def arrive(i):
        parts[i].coalesce(1).write.mode("append").parquet(f"{base}/in")

    def run(files=1):
        LS.start_ordered_feed(LS.lap_stream(spark, f"{base}/in", files), f"{base}/feed", f"{base}/ckpt", available_now=True).awaitTermination()

    for i in (4, 1, 5):
        arrive(i)
    run()
    seen = LS.current_laps(spark, f"{base}/feed").agg(F.max("version")).first()[0]
    for i in (0, 3, 2):
        arrive(i)
    run(2)  # restarted from its checkpoint
    run()  # nothing new
    whole = lp.drop("part")
    want = rows(LS.ordered_feed(LS.lap_state(whole)))
    current = LS.current_laps(spark, f"{base}/feed")
    assert rows(LS.ordered_feed(current)) == want
    changed = LS.current_laps(spark, f"{base}/feed", since=seen)
    assert 0 < changed.count() <= current.count()
    # The trailing laps of each driver come from the same state.
    keep = ["race", "year", "driver", "lap_number", "lap_time_history"]
    mine = trailing_history(LS.current_laps(spark, f"{base}/feed").withColumn("row_key", F.lit("")))
    assert rows(mine.select(*keep)) == rows(trailing_history(whole).select(*keep))


def test_payload_of_one_driver_equals_the_batch_feed(spark, sf_small):
    """For the feed's own driver and race the batch operators give the same rows."""
    from pitlane.operators import feed as FD
    from pitlane.plans.catalog import laps
    lp = laps(spark, sf_small)
    one = FD.feed_laps(lp)
    race, driver = one.select("race", "driver").first()
    state = LS.lap_state(lp.where((F.col("race") == race) & (F.col("driver") == driver)).withColumn("year", F.lit(0)))
    cols = ["lap_index", "lap_number", "total_laps", "compound", "is_last"]
    batch = FD.feed_payload(FD.build_feed(lp))
    got = LS.ordered_feed(state)
    assert rows(got.select("lap_index", "lap_number", "total_laps", "is_last")) == rows(batch.select("lap_index", "lap_number", "total_laps", "is_last"))
    assert set(cols) <= set(batch.columns)
