"""Small column helpers for rounding, clamping and defaults (JVM-side expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_even(c, digits: int) -> Column:
    """Half-even rounding of the binary value scaled by 10**digits (numpy/pandas `.round`)."""
    scale = float(10 ** digits)
    return F.rint(col_(c) * F.lit(scale)) / F.lit(scale)


def round_half_up(c, digits: int) -> Column:
    """Floor rule floor(x*10^d + 0.5)/10^d, identical in Spark and DuckDB; used for comparable output."""
    scale = float(10 ** digits)
    return F.floor(col_(c) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def clamp(c, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]. Inputs are NaN-free (sources turn NaN into null); null stays null."""
    x = col_(c)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(
        F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x.cast("double"))))


def or_default(c, default, zero_is_missing: bool = True) -> Column:
    """Value, or `default` when missing (and when 0 if zero_is_missing, like Python `x or d`)."""
    x = col_(c)
    cond = x.isNull()
    if zero_is_missing:
        cond = cond | (x == 0)
    return F.when(cond, F.lit(default)).otherwise(x)


def first_nonzero(*cols, default=None) -> Column:
    """First value that is neither null nor zero; `default` when none is."""
    out = F.lit(default) if default is not None else F.lit(None)
    for c in reversed(cols):
        x = col_(c)
        out = F.when(x.isNotNull() & (x != 0), x).otherwise(out)
    return out


def trunc_int(c) -> Column:
    """Truncating int cast (Python `int(float)`)."""
    return col_(c).cast("int")
