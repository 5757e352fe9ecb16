"""Explicit schemas. Nothing is inferred at read time."""

from pyspark.sql import types as T

# CSV header -> (internal snake-case name, Spark type). Order is the CSV order
# the strategy export is expected to use; readers select by name, not position.
LAP_COLUMNS = [
    ("Driver", "driver", T.StringType()),
    ("Race", "race", T.StringType()),
    ("Year", "year", T.IntegerType()),
    ("LapNumber", "lap_number", T.IntegerType()),
    ("Stint", "stint", T.IntegerType()),
    ("Position", "position", T.IntegerType()),
    ("LapTime (s)", "lap_time_s", T.DoubleType()),
    ("TyreLife", "tyre_life", T.DoubleType()),
    ("Compound", "compound", T.StringType()),
    ("LapTime_Delta", "lap_time_delta", T.DoubleType()),
    ("Normalized_TyreLife", "normalized_tyre_life", T.DoubleType()),
    ("RaceProgress", "race_progress", T.DoubleType()),
    ("Cumulative_Degradation", "cumulative_degradation", T.DoubleType()),
    ("Position_Change", "position_change", T.DoubleType()),
    ("Prev_TyreLife", "prev_tyre_life", T.DoubleType()),
    ("PitStop", "pit_stop", T.IntegerType()),
]

TELEMETRY_COLUMNS = [
    ("Team", "team", T.StringType()),
    ("Driver", "driver", T.StringType()),
    ("LapNumber", "lap_number", T.IntegerType()),
    ("SpeedFL", "speed_fl", T.DoubleType()),
    ("SpeedST", "speed_st", T.DoubleType()),
]


def csv_schema(columns):
    """Schema with the CSV header names (used by the CSV reader)."""
    return T.StructType([T.StructField(h, t, True) for h, _, t in columns])


def internal_schema(columns, with_key=True):
    fields = [T.StructField("row_key", T.StringType(), False)] if with_key else []
    fields += [T.StructField(n, t, True) for _, n, t in columns]
    return T.StructType(fields)


LAPS_CSV = csv_schema(LAP_COLUMNS)
LAPS = internal_schema(LAP_COLUMNS)
TELEMETRY_CSV = csv_schema(TELEMETRY_COLUMNS)
TELEMETRY = internal_schema(TELEMETRY_COLUMNS, with_key=False)

# Key columns whose absence drops a lap during cleaning.
CLEAN_KEYS = [
    "lap_time_s", "tyre_life", "compound", "position", "stint", "lap_number",
    "lap_time_delta", "normalized_tyre_life", "race_progress", "cumulative_degradation",
]

# Feature sets of the four model families.
REGRESSION_FEATURES = [
    "tyre_life", "compound_encoded", "position", "stint", "lap_number",
    "cumulative_degradation", "position_change", "prev_tyre_life", "pit_stop",
    "race_progress", "race_encoded", "year_encoded",
]
REGRESSION_TARGET = "laptime_normalized"
TREE_FEATURES = [
    "normalized_tyre_life", "race_progress", "lap_time_delta", "tyre_life", "compound_encoded",
]
TREE_TARGET = "ers_status"
CLUSTER_FEATURES = ["cumulative_degradation", "tyre_life", "laptime_normalized"]
SAFETY_FEATURES = ["lap_time_delta", "ers_risk", "race_progress", "tyre_life"]
SAFETY_TARGET = "evento_critico"

# History tables (append-only). id and timestamp are filled at write time;
# tables are partitioned by event_date, run_id and batch_id (see sinks/history.py).
_H = {
    "telemetry_data": [
        ("lap", T.IntegerType()), ("driver", T.StringType()), ("compound", T.StringType()),
        ("tyre_life", T.DoubleType()), ("lap_time", T.DoubleType()), ("position", T.IntegerType()),
        ("stint", T.IntegerType()), ("speed", T.DoubleType()), ("throttle", T.DoubleType()),
        ("brake", T.DoubleType()), ("rpm", T.DoubleType()),
    ],
    "superclipping_predictions": [
        ("predicted_laptime", T.DoubleType()), ("status", T.StringType()),
        ("velocidad", T.DoubleType()), ("soc_bateria", T.DoubleType()), ("mguk_kw", T.DoubleType()),
        ("throttle_pct", T.DoubleType()), ("aero_mode", T.StringType()),
        ("temp_bateria", T.DoubleType()),
    ],
    "alert_history": [
        ("severity", T.StringType()), ("title", T.StringType()), ("description", T.StringType()),
    ],
    "classification_results": [
        ("ers_status_predicted", T.StringType()), ("prob_normal", T.DoubleType()),
        ("prob_alerta", T.DoubleType()), ("prob_critico", T.DoubleType()),
        ("lap", T.IntegerType()), ("race", T.StringType()),
    ],
    "cluster_assignments": [
        ("cluster_id", T.IntegerType()), ("cluster_label", T.StringType()),
        ("tyre_life", T.DoubleType()), ("race_progress", T.DoubleType()), ("lap", T.IntegerType()),
    ],
    "safety_events": [
        ("is_critical", T.IntegerType()), ("probability_critical", T.DoubleType()),
        ("kernel", T.StringType()), ("lap", T.IntegerType()), ("ers_risk", T.DoubleType()),
    ],
}
HISTORY_TIME_COLUMN = {"telemetry_data": "created_at"}


def history_schema(table: str) -> T.StructType:
    ts = HISTORY_TIME_COLUMN.get(table, "timestamp")
    fields = [T.StructField("id", T.StringType(), False)]
    fields += [T.StructField(n, t, True) for n, t in _H[table]]
    fields += [
        T.StructField(ts, T.TimestampType(), False),
        T.StructField("event_date", T.DateType(), False),
    ]
    return T.StructType(fields)


HISTORY_TABLES = list(_H)
