
from pyspark.sql import functions as F

from pitlane import constants as C
from pitlane.functions import carstate, lookup, risk
from pitlane.operators import clean as CL


def _one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_status_bins_right_closed(spark):
    vals = _one(spark, [(0.0,), (3.0,), (3.0001,), (6.0,), (10.0,), (-0.02,), (10.02,)], "ers_risk double",
                risk.ers_status())
    assert vals == ["NORMAL", "NORMAL", "ALERTA", "ALERTA", "CRÍTICO", None, None]


def test_scaled_risk_equal_bounds_is_null(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.0), (0.5, 0.5, 0.0)],
                               "normalized_tyre_life double, race_progress double, lap_time_delta double")
    out = CL.dashboard_fields(df).collect()
    assert all(r["ers_risk"] is None and r["ers_status"] is None for r in out)


def test_delta_clipped_in_raw_risk(spark):
    vals = _one(spark, [(0.0, 0.0, -9.0), (0.0, 0.0, 9.0), (0.0, 0.0, 2.0)],
                "normalized_tyre_life double, race_progress double, lap_time_delta double", risk.ers_raw())
    assert vals == [5.0, -5.0, -2.0]


def test_duration_from_risk(spark):
    vals = _one(spark, [(0.0,), (10.0,), (5.0,)], "ers_risk double", risk.superclip_duration())
    assert vals == [1.0, 8.0, 4.5]


def test_live_status_edges(spark):
    vals = _one(spark, [(1.8,), (2.0,), (4.0,), (4.01,), (5.5,), (5.51,), (7.5,)], "d double",
                risk.live_status("d"))
    assert vals == ["CRÍTICO", "NORMAL", "NORMAL", "ALERTA", "ALERTA", "CRÍTICO", "CRÍTICO"]


SCHEMA = "normalized_tyre_life double, race_progress double, lap_time_delta double, tyre_life double"


def test_live_duration_defaults(spark):
    rows = [
        (0.0, 0.0, 0.0, 0.0),    # tyre life 0 reads as 1 -> 2 + 4.5*(0.15/40) = 2.016875 -> 2.02
        (0.0, 0.0, 0.0, 1.0),    # same value
        (None, 0.5, 0.0, 10.0),  # missing normalised tyre life -> 7.5
        (0.5, None, 0.0, 10.0),  # missing progress -> 7.5
        (0.5, 0.5, 0.0, None),   # missing tyre life -> 7.5
        (0.5, 0.5, None, 10.0),  # missing delta adds 0
        (0.5, 0.5, 0.0, 10.0),
        (1.0, 1.0, -10.0, 40.0),  # large value clamps to 7.5
    ]
    vals = _one(spark, rows, SCHEMA, risk.live_duration())
    assert vals[0] == vals[1] == 2.02
    assert vals[2] == vals[3] == vals[4] == 7.5
    assert vals[5] == vals[6]
    assert vals[7] == 7.5


def test_live_risk_defaults(spark):
    rows = [(None, 0.5, 0.0, 1.0), (0.5, None, 0.0, 1.0), (0.0, 0.0, None, 1.0), (0.0, 0.0, 0.0, 1.0),
            (1.0, 1.0, -9.0, 1.0)]
    vals = _one(spark, rows, SCHEMA, risk.live_risk())
    assert vals[0] == 10.0 and vals[1] == 10.0
    assert vals[2] == 0.0            # delta missing reads as +5: 0.65*(-5) + 2.5 < 0 -> 0
    assert vals[3] == 2.5
    assert vals[4] in (8.02, 8.03)   # 0.65*(2+1.5+5)+2.5 = 8.025, a rounding tie (±1 unit documented)


def test_laptime_vs_constant(spark):
    vals = _one(spark, [(80.5,), (0.0,), (None,)], "lap_time_s double", risk.laptime_vs_constant())
    assert vals == [2.5, 0.0, None]


def test_compound_code_unknown_is_one(spark):
    vals = _one(spark, [("SOFT",), ("WET",), ("soft",), ("HYPERSOFT",), (None,)], "compound string",
                lookup.compound_code())
    assert vals == [0.0, 4.0, 1.0, 1.0, 1.0]


def test_status_color_default(spark):
    vals = _one(spark, [("NORMAL",), ("ALERTA",), ("CRÍTICO",), ("other",), (None,)], "s string",
                lookup.status_color("s"))
    assert vals == ["#00ff88", "#ffcc00", "#cc0000", "#cc0000", "#cc0000"]


def test_speed_fallback_280(spark):
    rows = [(0.0, None), (None, None), (None, 210.0), (0.0, 0.0), (190.0, 300.0)]
    vals = _one(spark, rows, "speed_fl double, speed_st double", carstate.speed())
    assert vals == [280.0, 280.0, 210.0, 280.0, 190.0]


def test_car_state_values(spark):
    df = spark.createDataFrame([(280.0, 0.0, 10.0), (200.0, 0.5, None)],
                               "speed_kmh double, race_progress double, tyre_life double")
    cols = carstate.car_state_columns()
    out = df.select(*[v.alias(k) for k, v in cols.items()]).collect()
    a, b = out
    assert a["throttle_pct"] == 75.0 and a["brake_pressure"] == 40.0 and a["mguk_kw"] == 340.0
    assert a["soc_bateria"] == 65.0          # progress 0 reads as 0.5
    assert a["aero_mode"] == C.STRAIGHT_MODE and a["temp_bateria"] == 42.0
    assert b["throttle_pct"] == 55.0 and b["aero_mode"] == C.CORNER_MODE and b["temp_bateria"] is None


def test_tyre_wear_corners(spark):
    df = spark.createDataFrame([(10.9,), (1.0,), (50.0,)], "tyre_life double")
    out = df.select(*[v.alias(k) for k, v in carstate.tyre_wear_columns().items()]).collect()
    assert tuple(out[0]) == (25, 21, 31, 30)
    assert tuple(out[1]) == (5, 5, 11, 10)
    assert tuple(out[2]) == (95, 91, 95, 95)


def test_race_gaps(spark):
    df = spark.createDataFrame([(4, 1.0, -2.0), (3, None, None)],
                               "lap_number int, lap_time_delta double, position_change double")
    out = df.select(*[v.alias(k) for k, v in carstate.race_gap_columns().items()]).collect()
    assert tuple(out[0]) == (2, 0.6, 0.9)
    assert out[1]["sector"] == 1 and out[1]["gap_ahead"] is None


def test_cluster_labels_golden(spark):
    # two published cluster profiles and their labels
    df = spark.createDataFrame([(0, 1.413, 15.29, 0.3952, -32.935), (1, 1.719, 6.64, 30.3512, 2.049),
                                (2, 0.2, 30.0, 0.0, 20.0), (3, 3.0, 20.0, -1.0, 0.0), (4, 5.6, 20.0, 0.0, 9.0)],
                               "c int, ce double, t double, l double, d double")
    vals = [r[0] for r in df.orderBy("c").select(lookup.cluster_label("ce", "t", "l", "d")).collect()]
    assert vals == ["Stint estable (MEDIUM)", "Stint temprano (HARD)", "Degradación alta (SOFT)",
                    "Ritmo competitivo (INTER)", "Desgaste moderado (MIXED)"]


def test_sanitize_label(spark):
    vals = _one(spark, [("macro avg",), ("CRÍTICO",)], "l string", lookup.sanitize_label("l"))
    assert vals == ["macro_avg", "CRITICO"]


def test_critical_event_missing_is_zero(spark):
    df = spark.createDataFrame([(10.0, 8.0), (-10.0, 8.0), (10.0, 6.0), (None, 9.0), (10.0, None), (0.0, 9.0)],
                               "d double, r double")
    vals = [r[0] for r in df.select(risk.critical_event("d", "r", F.lit(-5.0), F.lit(5.0))).collect()]
    assert vals == [1, 1, 0, 0, 0, 0]
