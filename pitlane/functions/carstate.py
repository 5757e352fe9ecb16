"""Car state, race gaps and tyre wear derived from a lap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitlane import constants as C
from pitlane.functions.numeric import clamp, col_, first_nonzero, or_default, round_even


def speed(speed_fl="speed_fl", speed_st="speed_st") -> Column:
    """First non-zero, non-missing speed, else 280 (also after an unmatched telemetry join)."""
    return first_nonzero(speed_fl, speed_st, default=C.DEFAULT_SPEED_KMH).cast("double")


def car_state_columns(speed_col="speed_kmh", progress="race_progress", tyre_life="tyre_life") -> dict[str, Column]:
    """throttle, brake, battery charge, MGU-K power, aero mode and battery temperature."""
    s = col_(speed_col)
    throttle = clamp(F.lit(C.THROTTLE_BASE) + (s - F.lit(C.THROTTLE_SPEED_PIVOT)) * F.lit(C.THROTTLE_SPEED_SLOPE),
                     0.0, 100.0)
    brake = clamp(F.lit(C.BRAKE_BASE) - throttle * F.lit(C.BRAKE_THROTTLE_SLOPE), 0.0, 100.0)
    prog = or_default(progress, C.DEFAULT_PROGRESS)
    soc = F.greatest(F.lit(C.SOC_FLOOR), F.lit(C.SOC_BASE) - prog * F.lit(C.SOC_PROGRESS_SLOPE))
    return {
        "velocidad_kmh": round_even(s, 1),
        "soc_bateria": round_even(soc, 1),
        "throttle_pct": round_even(throttle, 1),
        "brake_pressure": round_even(brake, 1),
        "mguk_kw": round_even(F.lit(C.MGUK_BASE_KW) + throttle * F.lit(C.MGUK_THROTTLE_SLOPE), 1),
        "aero_mode": F.when(F.coalesce(s > C.STRAIGHT_MODE_SPEED, F.lit(False)), F.lit(C.STRAIGHT_MODE))
                      .otherwise(F.lit(C.CORNER_MODE)),
        "temp_bateria": round_even(F.lit(C.BATTERY_TEMP_BASE) + col_(tyre_life) * F.lit(C.BATTERY_TEMP_TYRE_SLOPE), 1),
    }


def race_gap_columns(lap="lap_number", delta="lap_time_delta", pos_change="position_change") -> dict[str, Column]:
    """sector, gap to the car ahead and behind (3 decimals). Missing inputs stay missing."""
    return {
        "sector": (col_(lap) % 3 + 1).cast("int"),
        "gap_ahead": round_even(F.lit(C.GAP_AHEAD_BASE) + col_(delta) * F.lit(C.GAP_AHEAD_SLOPE), 3),
        "gap_behind": round_even(F.lit(C.GAP_BEHIND_BASE) + F.abs(col_(pos_change)) * F.lit(C.GAP_BEHIND_SLOPE), 3),
    }


def gap_text(gap, sign: str) -> Column:
    """'+0.734s' style text with the 0.001 floor."""
    g = F.greatest(F.lit(C.GAP_FLOOR), col_(gap))
    return F.concat(F.lit(sign), g.cast("string"), F.lit("s"))


def tyre_wear_columns(tyre_life="tyre_life") -> dict[str, Column]:
    """base wear clamp(trunc(2.5*life), 5, 95) and the four corners."""
    life = col_(tyre_life).cast("int")
    base = F.least(F.lit(C.WEAR_MAX), F.greatest(F.lit(C.WEAR_MIN), (life * F.lit(C.WEAR_SLOPE)).cast("int")))
    return {
        "wear_fl": base,
        "wear_fr": F.greatest(F.lit(C.WEAR_MIN), base + F.lit(C.WEAR_FR_OFFSET)),
        "wear_rl": F.least(F.lit(C.WEAR_MAX), base + F.lit(C.WEAR_RL_OFFSET)),
        "wear_rr": F.least(F.lit(C.WEAR_MAX), base + F.lit(C.WEAR_RR_OFFSET)),
    }


def lap_event_log(lap="lap_number") -> Column:
    """event log of a lap: the entry of the lap itself."""
    return F.array(F.struct(F.concat(F.lit("LAP "), col_(lap).cast("int").cast("string")).alias("time"),
                            F.lit("SIM_LAP_REPLAY").alias("event"), F.lit("normal").alias("type")))


def interpretation(lap, label, tyre_mean, deg_mean) -> Column:
    """sentence from lap, cluster label and profile means; N/A when a mean is missing."""
    head, rest = C.CLUSTER_INTERPRETATION.split("{lap}")
    mid1, rest = rest.split("{label}")
    mid2, rest = rest.split("{tyre}")
    mid3, tail = rest.split("{deg}")
    na = F.lit("N/A")
    return F.concat(F.lit(head), F.coalesce(col_(lap).cast("int").cast("string"), F.lit("0")), F.lit(mid1),
                    col_(label), F.lit(mid2), F.coalesce(col_(tyre_mean).cast("string"), na), F.lit(mid3),
                    F.coalesce(col_(deg_mean).cast("string"), na), F.lit(tail))
