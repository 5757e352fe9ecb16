"""Risk, status and duration expressions (F01-F08, F19). All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitlane import constants as C
from pitlane.functions.numeric import clamp, col_, or_default, round_even


def ers_raw(ntl="normalized_tyre_life", progress="race_progress", delta="lap_time_delta") -> Column:
    """2*normalised tyre life + 1.5*progress - clip(delta, -5, 5)."""
    return (col_(ntl) * F.lit(C.RISK_W_TYRE) + col_(progress) * F.lit(C.RISK_W_PROGRESS)
            - clamp(delta, -C.RISK_DELTA_CLIP, C.RISK_DELTA_CLIP))


def ers_scaled(raw, lo, hi) -> Column:
    """min-max scale to 0..10. max = min gives null (try_divide), not an error."""
    return F.try_divide(col_(raw) - lo, hi - lo) * F.lit(C.RISK_SCALE_MAX)


def ers_status(risk="ers_risk") -> Column:
    """right-closed buckets (-0.01,3] NORMAL, (3,6] ALERTA, (6,10.01] CRÍTICO, else null."""
    r = col_(risk)
    e = C.STATUS_BIN_EDGES
    expr = F.lit(None).cast("string")
    for i in reversed(range(len(C.STATUS_LEVELS))):
        expr = F.when((r > e[i]) & (r <= e[i + 1]), F.lit(C.STATUS_LEVELS[i])).otherwise(expr)
    return expr


def superclip_duration(risk="ers_risk") -> Column:
    """round(1 + risk/10*7, 2)."""
    return round_even(F.lit(C.DURATION_BASE) + col_(risk) / F.lit(C.RISK_SCALE_MAX) * F.lit(C.DURATION_SPAN), 2)


def live_duration(ntl="normalized_tyre_life", progress="race_progress", delta="lap_time_delta",
                  tyre_life="tyre_life") -> Column:
    """row-local superclipping duration in 1.5..7.5.

    Missing tyre, progress or tyre life make the score unknown, which the live
    formula resolves to the cap 7.5; a missing delta contributes 0; tyre life 0
    counts as 1.
    """
    life = or_default(tyre_life, 1.0)
    r = (col_(ntl) * F.lit(C.LIVE_W_TYRE) + col_(progress) * F.lit(C.LIVE_W_PROGRESS)
         + F.greatest(F.lit(0.0), -F.coalesce(col_(delta), F.lit(0.0))) * F.lit(C.LIVE_W_DELTA)
         + life / F.lit(C.LIVE_LIFE_DIVISOR) * F.lit(C.LIVE_W_LIFE))
    d = round_even(F.lit(C.LIVE_DURATION_BASE) + r * F.lit(C.LIVE_DURATION_SLOPE), 2)
    d = F.greatest(F.lit(C.LIVE_DURATION_MIN), F.least(F.lit(C.LIVE_DURATION_MAX), d))
    return F.when(col_(ntl).isNull() | col_(progress).isNull() | col_(tyre_life).isNull(),
                  F.lit(C.LIVE_DURATION_MAX)).otherwise(d)


def live_status(duration="superclipping_duration") -> Column:
    """[2,4] NORMAL, (4,5.5] ALERTA, everything else (also 1.5..2) CRÍTICO."""
    d = col_(duration)
    lo, hi = C.LIVE_NORMAL_RANGE
    return (F.when((d >= lo) & (d <= hi), F.lit(C.STATUS_NORMAL))
            .when((d > hi) & (d <= C.LIVE_ALERT_UPPER), F.lit(C.STATUS_ALERT))
            .otherwise(F.lit(C.STATUS_CRITICAL)))


def live_risk(ntl="normalized_tyre_life", progress="race_progress", delta="lap_time_delta") -> Column:
    """clamp(0.65*raw + 2.5, 0, 10) rounded to 2 decimals, no global scan.

    Missing tyre or progress give 10; a missing delta reads as the clip bound +5.
    """
    raw = (col_(ntl) * F.lit(C.RISK_W_TYRE) + col_(progress) * F.lit(C.RISK_W_PROGRESS)
           - F.coalesce(clamp(delta, -C.RISK_DELTA_CLIP, C.RISK_DELTA_CLIP), F.lit(C.RISK_DELTA_CLIP)))
    v = F.greatest(F.lit(0.0), F.least(F.lit(C.RISK_SCALE_MAX), raw * F.lit(C.LIVE_RISK_SLOPE) + F.lit(C.LIVE_RISK_OFFSET)))
    return F.when(col_(ntl).isNull() | col_(progress).isNull(), F.lit(C.RISK_SCALE_MAX)).otherwise(round_even(v, 2))


def laptime_vs_constant(lap_time="lap_time_s", reference: float = C.LAPTIME_REFERENCE_S) -> Column:
    """lap time minus a constant reference, 4 decimals; 0 reads as the reference."""
    lt = F.when(col_(lap_time) == 0, F.lit(reference)).otherwise(col_(lap_time))
    return round_even(lt - F.lit(reference), 4)


def critical_event(delta, risk, p_low, p_high) -> Column:
    """(delta > p95 or delta < p5) and risk > 7, as 0/1. Missing values give 0."""
    d = col_(delta)
    cond = ((d > p_high) | (d < p_low)) & (col_(risk) > F.lit(C.EVENT_RISK_THRESHOLD))
    return F.coalesce(cond, F.lit(False)).cast("int")
