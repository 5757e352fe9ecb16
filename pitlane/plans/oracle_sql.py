"""SQL building blocks for the DuckDB oracle (same derivations as the Spark operators)."""

from __future__ import annotations

from pitlane.sources.laps import LAPS_SQL
from pitlane.sources.telemetry import TELEMETRY_SQL

KEYS_NOT_NULL = " AND ".join(
    f"{c} IS NOT NULL" for c in [
        "lap_time_s", "tyre_life", "compound", "position", "stint", "lap_number",
        "lap_time_delta", "normalized_tyre_life", "race_progress", "cumulative_degradation"])

RAW_RISK = ("normalized_tyre_life * 2e0 + race_progress * 1.5e0 "
            "- greatest(-5e0, least(5e0, lap_time_delta))")

CTES = {
    "laps": LAPS_SQL,
    "telemetry": TELEMETRY_SQL,
    "p01": f"p01 AS (SELECT * FROM laps WHERE {KEYS_NOT_NULL})",
    "thr": "thr AS (SELECT median(lap_time_s) + 2e0 * stddev_samp(lap_time_s) AS t FROM p01)",
    "trimmed": "trimmed AS (SELECT p01.* FROM p01, thr WHERE lap_time_s < t)",
    "clean": "clean AS (SELECT * FROM trimmed WHERE position BETWEEN 1 AND 20 AND lap_time_s > 0)",
    "raw": f"raw AS (SELECT clean.*, {RAW_RISK} AS ers_raw FROM clean)",
    "bounds": "bounds AS (SELECT min(ers_raw) AS lo, max(ers_raw) AS hi FROM raw)",
    "risk": ("risk AS (SELECT raw.*, (ers_raw - lo) / nullif(hi - lo, 0e0) * 10e0 AS ers_risk "
             "FROM raw, bounds)"),
    "status": ("status AS (SELECT risk.*, "
               "CASE WHEN ers_risk > -0.01e0 AND ers_risk <= 3e0 THEN 'NORMAL' "
               "WHEN ers_risk > 3e0 AND ers_risk <= 6e0 THEN 'ALERTA' "
               "WHEN ers_risk > 6e0 AND ers_risk <= 10.01e0 THEN 'CRÍTICO' END AS ers_status, "
               "round_even((1e0 + ers_risk / 10e0 * 7e0) * 100e0, 0) / 100e0 AS superclipping_duration "
               "FROM risk)"),
    "medians": ("medians AS (SELECT race, median(lap_time_s) AS laptime_baseline FROM status "
                "WHERE race IS NOT NULL GROUP BY race)"),
    "codes": ("codes AS (SELECT race_text, CAST(row_number() OVER (ORDER BY race_text) - 1 AS INTEGER) "
              "AS race_encoded FROM (SELECT DISTINCT coalesce(race, 'nan') AS race_text FROM status))"),
    "y0": "y0 AS (SELECT min(year) AS y0 FROM status)",
    "enc": ("enc AS (SELECT s.*, "
            "CAST(CASE s.compound WHEN 'SOFT' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HARD' THEN 2 "
            "WHEN 'INTERMEDIATE' THEN 3 WHEN 'WET' THEN 4 ELSE 1 END AS DOUBLE) AS compound_encoded, "
            "m.laptime_baseline, s.lap_time_s - m.laptime_baseline AS laptime_normalized, "
            "c.race_encoded, CAST(s.year - y0.y0 AS INTEGER) AS year_encoded "
            "FROM status s LEFT JOIN medians m ON s.race = m.race "
            "LEFT JOIN codes c ON coalesce(s.race, 'nan') = c.race_text, y0)"),
}

ORDER = ["laps", "telemetry", "p01", "thr", "trimmed", "clean", "raw", "bounds", "risk", "status",
         "medians", "codes", "y0", "enc"]

DEPS = {
    "p01": ["laps"], "thr": ["p01"], "trimmed": ["p01", "thr"], "clean": ["trimmed"], "raw": ["clean"],
    "bounds": ["raw"], "risk": ["raw", "bounds"], "status": ["risk"], "medians": ["status"],
    "codes": ["status"], "y0": ["status"], "enc": ["status", "medians", "codes", "y0"],
}


def with_ctes(needed: list[str], body: str, extra: list[str] | None = None) -> str:
    """Prefix `body` with the named CTEs (and their dependencies), then any extra CTE texts."""
    want: set[str] = set()

    def add(n):
        if n in want:
            return
        want.add(n)
        for d in DEPS.get(n, []):
            add(d)

    for n in needed:
        add(n)
    parts = [CTES[n].strip() for n in ORDER if n in want] + [e.strip() for e in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n" + body


def r(expr: str, digits: int) -> str:
    """Floor rounding rule in SQL (matches functions.numeric.round_half_up)."""
    s = f"1e{digits}"
    return f"(CAST(floor(({expr}) * {s} + 0.5e0) AS DOUBLE) / {s})"


def rint(expr: str, digits: int) -> str:
    """Half-even rounding of the scaled binary value (matches functions.numeric.round_even)."""
    s = f"1e{digits}"
    return f"(round_even(({expr}) * {s}, 0) / {s})"
