"""Newest-first history reads, and the lap CSV of which no record is lost."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitlane import constants as C
from pitlane import schemas as S
from pitlane.sinks import history as H
from pitlane.sources.laps import read_laps_csv, split_laps_csv


def alerts(spark, days):
    """{day: rows} as alert rows."""
    t0 = dt.datetime(2024, 1, 1, 12)
    rows = [(f"{d}-{i}", "s", "t", "x", t0 + dt.timedelta(days=d, seconds=i)) for d, n in days.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, severity string, title string, description string, ts timestamp")
    return H.history_rows(df, "alert_history", F.col("k"), F.col("ts"))


def test_only_the_newest_days_are_read(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    H.init_tables(spark, base)
    H.append(alerts(spark, {d: 3 for d in range(60)}), base, "alert_history", 0, "a")
    want = [tuple(r) for r in H.recent(H.read_table(spark, base, "alert_history"), 3).collect()]
    asked, real = [], H.read_table
    monkeypatch.setattr(H, "read_table", lambda *a, since=None: asked.append(since) or real(*a, since=since))
    assert [tuple(r) for r in H.recent_rows(spark, base, "alert_history", 3).collect()] == want
    assert asked == ["2024-02-29"] and len(H.days_of(spark, base, "alert_history")) == 60
    newest = H.recent_rows(spark, base, "alert_history", 3)
    assert "event_date" in newest._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]
    # Late rows in old days are found where the newest days do not hold enough.
    asked.clear()
    H.append(alerts(spark, {2: 2}).withColumn("id", F.concat("id", F.lit("late"))), base, "alert_history", 1, "a")
    for k in (7, 500):
        got = [tuple(r) for r in H.recent_rows(spark, base, "alert_history", k).collect()]
        assert got == [tuple(r) for r in H.recent(real(spark, base, "alert_history"), k).collect()]
    assert asked[0] == "2024-02-29" and asked[-1] is None and sum("late" in r[0] for r in got) == 2


def files(spark, base):
    import glob
    return len(glob.glob(f"{base}/alert_history/**/*.parquet", recursive=True)) + len(glob.glob(f"{base}/_compact/**/*.parquet", recursive=True))


def test_compaction_of_many_batches(spark, tmp_path, monkeypatch):
    """Batches of a stream that goes on, plain appends, replays of the newest batch and of a merged one."""
    base = str(tmp_path)
    H.init_tables(spark, base)

    def batch(i, run="stream a"):
        ts = H.batch_time(spark, base, run, i)
        rows = spark.createDataFrame([(f"{run}{i}-{j}", "s", "t", "x") for j in range(3)], "k string, severity string, title string, description string")
        H.append(H.history_rows(rows, "alert_history", F.col("k"), ts), base, "alert_history", i, run)

    def ids():
        return sorted(r["id"] for r in H.read_table(spark, base, "alert_history").collect())

    for i in range(12):
        batch(i)
    H.append(alerts(spark, {3: 4, 5: 2}), base, "alert_history")  # a plain append
    before, many = ids(), files(spark, base)
    assert H.compact(spark, base, "alert_history") == 11 + 1  # of the stream all but the newest, and the append
    assert ids() == before and files(spark, base) < many
    batch(11)  # replayed while it is the newest
    batch(2)  # merged already: its rows are there
    assert ids() == before
    for i in range(12, 16):
        batch(i)
    batch(0, "b")
    before = ids()
    assert len(before) == len(set(before)) == 16 * 3 + 3 + 6
    assert H.compact(spark, base, "alert_history") == 4 and H.generation(spark, base, "alert_history") == 2
    assert ids() == before and H.compact(spark, base, "alert_history") == 0
    newest = [tuple(r) for r in H.recent_rows(spark, base, "alert_history", 5).collect()]
    assert newest == [tuple(r) for r in H.recent(H.read_table(spark, base, "alert_history"), 5).collect()]
    # A compaction that dies before its marker changes nothing for readers.
    batch(16)
    before = ids()
    with monkeypatch.context() as m:
        m.setattr(H, "touch", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            H.compact(spark, base, "alert_history")
    assert ids() == before and H.compact(spark, base, "alert_history") == 1 and ids() == before


def test_empty_history(spark, tmp_path):
    H.init_tables(spark, str(tmp_path))
    assert H.recent_rows(spark, str(tmp_path), "safety_events").collect() == []


def test_every_record_is_good_or_bad(spark, tmp_path):
    names = [h for h, _, _ in S.LAP_COLUMNS]
    good = ["VER", "Monza", "2024", "3", "1", "2", "81.5", "4", "SOFT", "0.1", "0.2", "0.3", "0.4", "1", "3.0", "0"]
    lines = [good[:9] + [s] + good[10:] for s in C.NULL_STRINGS if s] + [[s, s] + good[2:] for s in ("nan", "NULL", "#N/A")] + [good[:9] + [""] + good[10:]]
    lines += [good[:2] + ["2024.0"] + good[3:], ["12"] + good[1:], good[:6] + ["1e2"] + good[7:]]
    bad = [good[:2] + ["year"] + good[3:], good[:3] + ["3.5"] + good[4:], good[:6] + ["fast", "old"] + good[8:], good[:7], good + ["more"]]
    text = "\n".join(",".join(x) for x in [names, *lines, *bad])
    (tmp_path / "laps.csv").write_text(text + "\n")
    laps, wrong = split_laps_csv(spark, str(tmp_path / "laps.csv"))
    assert laps.count() == len(lines) and wrong.count() == len(bad)
    assert laps.count() + wrong.count() == len(text.split("\n")) - 1
    got = {r["problem"]: r for r in wrong.collect()}
    assert set(got) == {"year", "lap_number", "lap_time_s,tyre_life", "number of fields"}
    assert got["year"]["record"] == ",".join(bad[0]) and got["year"]["file"].endswith("laps.csv")
    rows = laps.collect()
    assert sum(r["lap_time_delta"] is None for r in rows) == len(C.NULL_STRINGS) and sum(r["driver"] is None for r in rows) == 3
    assert {r["year"] for r in rows} == {2024} and laps.schema == read_laps_csv(spark, str(tmp_path / "laps.csv")).schema
