"""Constants of the lap-analytics domain.

FIXED VALUES -- these must equal the values the analysed lap workflow uses,
otherwise encoded features, status labels and colours would not line up with
the trained models and dashboards. They are stated here once, in plain text.
"""

# --- fixed values: compound codes (unknown compound -> DEFAULT_COMPOUND_CODE)
COMPOUND_CODES = {"SOFT": 0, "MEDIUM": 1, "HARD": 2, "INTERMEDIATE": 3, "WET": 4}
DEFAULT_COMPOUND_CODE = 1

# --- fixed values: compound names used when labelling clusters by mean code
CLUSTER_COMPOUND_NAMES = {0: "SOFT", 1: "MEDIUM", 2: "HARD", 3: "INTER", 4: "WET"}
CLUSTER_COMPOUND_FALLBACK = "MIXED"

# --- fixed values: ERS status levels, in bucket order, and their bin edges.
# Bins are right-closed: (-0.01, 3], (3, 6], (6, 10.01].
STATUS_NORMAL = "NORMAL"
STATUS_ALERT = "ALERTA"
STATUS_CRITICAL = "CRÍTICO"
STATUS_LEVELS = [STATUS_NORMAL, STATUS_ALERT, STATUS_CRITICAL]
STATUS_BIN_EDGES = [-0.01, 3.0, 6.0, 10.01]

# --- fixed values: status colours (unknown status -> critical colour)
STATUS_COLORS = {"NORMAL": "#00ff88", "ALERTA": "#ffcc00", "CRÍTICO": "#cc0000"}
DEFAULT_STATUS_COLOR = "#cc0000"

# --- fixed values: cluster label templates, checked in this order
CLUSTER_LABEL_HIGH_DEG = "Degradación alta ({})"
CLUSTER_LABEL_PACE = "Ritmo competitivo ({})"
CLUSTER_LABEL_EARLY = "Stint temprano ({})"
CLUSTER_LABEL_MODERATE = "Desgaste moderado ({})"
CLUSTER_LABEL_STABLE = "Stint estable ({})"

# --- fixed values: interpretation sentence of a cluster assignment
CLUSTER_INTERPRETATION = (
    "Vuelta {lap}: perfil '{label}'. "
    "TyreLife promedio del cluster: {tyre}, "
    "degradación acumulada: {deg}."
)

# --- fixed values: risk formula weights
RISK_W_TYRE = 2.0
RISK_W_PROGRESS = 1.5
RISK_DELTA_CLIP = 5.0
RISK_SCALE_MAX = 10.0
DURATION_BASE = 1.0
DURATION_SPAN = 7.0

# --- fixed values: row-local (live) superclipping duration
LIVE_W_TYRE = 0.35
LIVE_W_PROGRESS = 0.30
LIVE_W_DELTA = 0.20
LIVE_W_LIFE = 0.15
LIVE_LIFE_DIVISOR = 40.0
LIVE_DURATION_BASE = 2.0
LIVE_DURATION_SLOPE = 4.5
LIVE_DURATION_MIN = 1.5
LIVE_DURATION_MAX = 7.5
LIVE_NORMAL_RANGE = (2.0, 4.0)
LIVE_ALERT_UPPER = 5.5

# --- fixed values: live risk approximation (no global scan)
LIVE_RISK_SLOPE = 0.65
LIVE_RISK_OFFSET = 2.5

# --- fixed values: lap-time reference used by the live cluster scorer
LAPTIME_REFERENCE_S = 78.0

# --- fixed values: car state derived from a lap
DEFAULT_SPEED_KMH = 280.0
THROTTLE_BASE = 55.0
THROTTLE_SPEED_PIVOT = 200.0
THROTTLE_SPEED_SLOPE = 0.25
BRAKE_BASE = 100.0
BRAKE_THROTTLE_SLOPE = 0.8
SOC_BASE = 85.0
SOC_PROGRESS_SLOPE = 40.0
SOC_FLOOR = 30.0
MGUK_BASE_KW = 280.0
MGUK_THROTTLE_SLOPE = 0.8
STRAIGHT_MODE_SPEED = 250.0
STRAIGHT_MODE = "STRAIGHT MODE"
CORNER_MODE = "CORNER MODE"
BATTERY_TEMP_BASE = 38.0
BATTERY_TEMP_TYRE_SLOPE = 0.4
DEFAULT_PROGRESS = 0.5
DEFAULT_TYRE_LIFE_TEMP = 10.0

# --- fixed values: race gaps
GAP_AHEAD_BASE = 0.5
GAP_AHEAD_SLOPE = 0.1
GAP_BEHIND_BASE = 0.8
GAP_BEHIND_SLOPE = 0.05
GAP_FLOOR = 0.001

# --- fixed values: tyre wear
WEAR_SLOPE = 2.5
WEAR_MIN = 5
WEAR_MAX = 95
WEAR_FR_OFFSET = -4
WEAR_RL_OFFSET = 6
WEAR_RR_OFFSET = 5

# --- fixed values: critical-event rule percentiles and risk threshold
EVENT_LOW_Q = 0.05
EVENT_HIGH_Q = 0.95
EVENT_RISK_THRESHOLD = 7.0

# --- fixed values: model settings
DT_MAX_DEPTH = 5
KMEANS_K_RANGE = list(range(2, 9))
KMEANS_SWEEP_SAMPLE = 20_000
TEST_FRACTION = 0.2
DASHBOARD_SAMPLE = 200
RESULTS_HEAD = 50
RECENT_LIMIT = 10
TRAILING_LAPS = 20
LEADERBOARD_SIZE = 5

# --- fixed values: feed selection defaults
FEED_DRIVER = "VER"
FEED_RACE_PATTERN = "Monaco"
FEED_TEAM = "Red Bull Racing"

# --- fixed values: demo lap used when no lap is available for scoring
DEMO_LAP = {
    "lap_number": 42,
    "normalized_tyre_life": 0.65,
    "race_progress": 0.54,
    "lap_time_delta": 0.12,
    "tyre_life": 28.0,
    "compound": "MEDIUM",
    "lap_time_s": 78.5,
    "cumulative_degradation": 12.0,
    "race": "Monaco Grand Prix",
}

# --- fixed values: spellings read as missing in text columns
NULL_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
                "NaN", "None", "n/a", "nan", "null"]
