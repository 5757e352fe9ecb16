"""Operators on hand-made frames: cleaning, encoding, aggregation, feed and evaluation semantics."""

from pyspark.sql import functions as F

from pitlane import schemas as S
from pitlane.operators import clean as CL
from pitlane.operators import dashboards as DB
from pitlane.operators import evaluate as EV
from pitlane.operators import feed as FD
from pitlane.operators import sampling as SM


def _laps(spark, rows):
    """rows: dicts with some lap columns; missing columns are null."""
    names = [f.name for f in S.LAPS.fields]
    full = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(full, S.LAPS)


def _lap(i, **kw):
    base = dict(row_key=f"k{i:04d}", driver="VER", race="Monaco Grand Prix", year=2024, lap_number=i % 78 + 1,
                stint=1, position=3, lap_time_s=80.0 + i % 7, tyre_life=10.0, compound="SOFT", lap_time_delta=0.1,
                normalized_tyre_life=0.2, race_progress=0.5, cumulative_degradation=1.0, position_change=1.0,
                prev_tyre_life=9.0, pit_stop=0)
    base.update(kw)
    return base


def test_one_row_trims_everything(spark):
    df = _laps(spark, [_lap(1)])
    assert CL.clean_rows(df).count() == 0


def test_trim_is_strict_and_upper_only(spark):
    rows = [_lap(i, lap_time_s=80.0) for i in range(20)] + [_lap(99, lap_time_s=1000.0), _lap(98, lap_time_s=1.0)]
    out = {r["row_key"] for r in CL.clean_rows(_laps(spark, rows)).collect()}
    assert "k0099" not in out and "k0098" in out


def test_dropna_and_ranges(spark):
    rows = [_lap(i) for i in range(10)] + [_lap(20, tyre_life=None), _lap(21, position=0), _lap(22, position=21),
                                           _lap(23, position=20)]
    out = {r["row_key"] for r in CL.clean_rows(_laps(spark, rows)).collect()}
    assert "k0020" not in out and "k0021" not in out and "k0022" not in out and "k0023" in out


def test_null_race_has_no_baseline_but_code_of_nan(spark):
    rows = [_lap(i, race="B race" if i % 2 else "A race") for i in range(10)] + [_lap(50, race=None)]
    out = CL.encode(_laps(spark, rows)).collect()
    by = {r["row_key"]: r for r in out}
    assert by["k0050"]["laptime_baseline"] is None and by["k0050"]["laptime_normalized"] is None
    codes = {r["race"]: r["race_encoded"] for r in out}
    assert codes == {"A race": 0, "B race": 1, None: 2}  # 'nan' sorts after upper-case names


def test_year_offset(spark):
    rows = [_lap(1, year=2021), _lap(2, year=2023)]
    out = {r["row_key"]: r["year_encoded"] for r in CL.attach_year_offset(_laps(spark, rows)).collect()}
    assert out == {"k0001": 0, "k0002": 2}


def test_distribution_keeps_empty_levels(spark):
    df = spark.createDataFrame([("NORMAL",), ("NORMAL",), (None,)], "ers_status string")
    out = {r["ers_status"]: r["n"] for r in DB.ers_distribution(df).collect()}
    assert out == {"NORMAL": 2, "ALERTA": 0, "CRÍTICO": 0}


def test_first_non_null_per_lap(spark):
    rows = [_lap(1, row_key="a", lap_number=5, tyre_life=None, year=2024),
            _lap(2, row_key="b", lap_number=5, tyre_life=12.0, year=2024),
            _lap(3, row_key="c", lap_number=5, tyre_life=99.0, year=2025)]
    out = FD.first_per_lap(_laps(spark, rows)).collect()
    assert len(out) == 1 and out[0]["tyre_life"] == 12.0 and out[0]["row_key"] == "a"


def test_chosen_race_pattern_then_mode(spark):
    rows = [_lap(i, race="Italy") for i in range(5)] + [_lap(10, race="Spain"), _lap(11, race=None)]
    df = _laps(spark, rows)
    assert df.select(FD.chosen_race(df)).first()[0] == "Italy"
    rows.append(_lap(20, race="MONACO street"))
    df2 = _laps(spark, rows)
    assert df2.select(FD.chosen_race(df2)).first()[0] == "MONACO street"


def test_feed_payload_cursor(spark):
    rows = [_lap(i, lap_number=i + 1) for i in range(4)] + [_lap(9, driver="D2")]
    feed = FD.build_feed(_laps(spark, rows), None)
    out = FD.feed_payload(feed).orderBy("lap_index").collect()
    assert [r["lap_index"] for r in out] == [0, 1, 2, 3]
    assert all(r["total_laps"] == 4 for r in out) and [r["is_last"] for r in out] == [False, False, False, True]


def test_leaderboard_top5_and_gap(spark):
    rows = [_lap(i, lap_number=1, position=p, lap_time_s=80.0 + p, driver=f"D{p}") for i, p in
            enumerate([7, 1, 3, 2, 5, 4, 6])]
    out = FD.leaderboard(_laps(spark, rows), highlight_driver="D3").orderBy("slot").collect()
    assert [r["position"] for r in out] == [1, 2, 3, 4, 5]
    assert [r["gap_s"] for r in out] == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert [r["highlight"] for r in out] == [False, False, True, False, False]


def test_trailing_history_length(spark):
    rows = [_lap(i, lap_number=i + 1) for i in range(30)]
    h = FD.trailing_history(_laps(spark, rows)).orderBy("lap_number").collect()
    assert [len(r["lap_time_history"]) for r in h][:3] == [1, 2, 3]
    assert len(h[-1]["lap_time_history"]) == 20 and h[-1]["lap_time_history"][0]["t"] == 11


def test_classification_report_unseen_class_is_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "a")], "t string, p string")
    rep = {r["label"]: r for r in EV.classification_report(df, "t", "p").collect()}
    assert rep["b"]["precision"] == 0.0 and rep["b"]["f1"] == 0.0 and rep["b"]["support"] == 1
    assert abs(rep["a"]["precision"] - 2 / 3) < 1e-12 and rep["a"]["recall"] == 1.0
    assert abs(rep["accuracy"]["f1"] - 2 / 3) < 1e-12


def test_confusion_matrix_all_pairs(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "t string, p string")
    out = {(r["truth"], r["predicted"]): r["n"] for r in EV.confusion_matrix(df, "t", "p").collect()}
    assert out == {("a", "a"): 1, ("a", "b"): 0, ("b", "a"): 1, ("b", "b"): 0}


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)], "y double, p double")
    m = EV.regression_metrics(df, "y", "p").first()
    assert abs(m["mae"] - 1 / 3) < 1e-12 and abs(m["mse"] - 1 / 6) < 1e-12 and abs(m["r2"] - 0.75) < 1e-12


def test_silhouette_matches_brute_force(spark):
    import numpy as np

    rng = np.random.RandomState(0)
    pts = np.vstack([rng.normal(0, 1, (30, 2)), rng.normal(4, 1, (25, 2)), [[10.0, 10.0]]])
    lab = np.array([0] * 30 + [1] * 25 + [2])
    df = spark.createDataFrame([(f"r{i}", float(x), float(y), int(l)) for i, ((x, y), l) in enumerate(zip(pts, lab))],
                               "row_key string, x double, y double, l int")
    got = EV.silhouette(df, ["x", "y"], ["l"]).first()["l"]
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    s = []
    for i in range(len(pts)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    assert abs(got - float(np.mean(s))) < 1e-9


def test_hash_split_is_deterministic_and_disjoint(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("row_key"))
    tr, te = SM.hash_split(df)
    tr2, te2 = SM.hash_split(df.repartition(7))
    a = {r[0] for r in te.collect()}
    assert a == {r[0] for r in te2.collect()}
    assert tr.count() + te.count() == 2000 and not (a & {r[0] for r in tr.collect()})
    assert 300 < len(a) < 500


def test_hash_sample_exact_size(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("row_key"))
    s = SM.hash_sample(df, 321)
    assert s.count() == 321
    assert SM.hash_sample(df, 10_000).count() == 5000


def test_stratified_cap_exact(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("row_key"),
                                  (F.col("id") % 10 == 0).cast("int").alias("y"))
    out = SM.stratified_cap(df, "y", 500)
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {0: 450, 1: 50}


def test_empty_driver_selection_is_an_error(spark):
    import pytest

    from pitlane.sources.laps import require_rows

    df = _laps(spark, [_lap(1)])
    with pytest.raises(ValueError):
        require_rows(FD.driver_laps(df, "NOBODY"), "driver NOBODY")
    assert require_rows(FD.driver_laps(df, "VER"), "driver VER").count() == 1


def test_missing_year_is_an_error(spark):
    import pytest

    df = _laps(spark, [_lap(1, year=None), _lap(2)])
    with pytest.raises(Exception, match="missing year"):
        CL.attach_year_offset(df).collect()


def test_quantiles_by_counting(spark, monkeypatch):
    import random

    import numpy as np

    r = random.Random(1)
    rows = [(g, v) for g, n in (("a", 501), ("b", 1), (None, 40), ("d", 2)) for v in (r.choice((r.uniform(-5, 5), 1.0, 1e12)) for _ in range(n))]
    rows += [("c", None), ("a", None), ("e", 7.0), ("e", 7.0)]
    df = spark.createDataFrame(rows, "race string, x double")
    for buckets, state in ((4096, 20_000), (256, 2)):
        monkeypatch.setattr(CL, "QUANTILE_BUCKETS", buckets)
        monkeypatch.setattr(CL, "MAX_DRIVER_STATE", state)
        got = {x["race"]: x["q"] for x in CL.quantiles(df, "x", [0.05, 0.5, 0.95], ["race"]).collect()}
        assert set(got) == {"a", "b", None, "d", "e"}
        for g, q in got.items():
            assert np.allclose(q, np.quantile([v for k, v in rows if k == g and v is not None], [0.05, 0.5, 0.95]), rtol=1e-12)
        assert CL.quantiles(df, "x", 0.5).first()["q"] == float(np.median([v for _, v in rows if v is not None]))
    assert CL.quantiles(df.limit(0), "x", 0.5).count() == 0


def test_hash_sample_of_repeated_keys(spark):
    df = spark.range(20_000).select((F.col("id") % 7).cast("string").alias("row_key"), "id")
    assert SM.hash_sample(df, 200).count() == 200
    assert SM.hash_sample(df.limit(0), 5).count() == 0


def test_stratified_split_and_cap(spark):
    import math

    sizes = {0: 1000, 1: 37, None: 5}
    rows = [(f"k{c}-{i}", c) for c, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "row_key string, y int")
    out = SM.mark_stratified(df, "y").groupBy("y").agg(F.count_if("is_test").alias("t")).collect()
    assert {r["y"]: r["t"] for r in out} == {c: math.ceil(0.2 * n) for c, n in sizes.items()}
    for cap in (1, 10, 500, 1041, 5000):
        kept = {r["y"]: r["n"] for r in SM.stratified_cap(df, "y", cap).groupBy("y").agg(F.count("*").alias("n")).collect()}
        assert sum(kept.values()) == min(cap, 1042) and kept == {c: n for c, n in SM.class_quotas(sizes, cap).items() if n}


def test_leaderboard_nested(spark):
    rows = [_lap(i, lap_number=1, position=p, lap_time_s=80.0 + p, driver=f"D{p}") for i, p in enumerate([3, 1, 2])]
    nested = FD.leaderboard_nested(FD.leaderboard(_laps(spark, rows))).first()
    assert [e["position"] for e in nested["leaderboard"]] == [1, 2, 3]


def test_exact_split_size(spark):
    import math

    df = spark.range(1237).select(F.col("id").cast("string").alias("row_key"))
    out = SM.exact_split(df)
    assert out.filter("is_test").count() == math.ceil(0.2 * 1237)
    small = spark.range(3).select(F.col("id").cast("string").alias("row_key"))
    assert SM.exact_split(small).filter("is_test").count() == 1
