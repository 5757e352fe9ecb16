"""Small-dictionary lookups with defaults."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitlane import constants as C
from pitlane.functions.numeric import col_


def _literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def compound_code(compound="compound") -> Column:
    """SOFT..WET -> 0..4, anything else (also missing) -> 1, as double. Case-sensitive."""
    return F.coalesce(_literal_map(C.COMPOUND_CODES)[col_(compound)],
                      F.lit(C.DEFAULT_COMPOUND_CODE)).cast("double")


def status_color(status="ers_status") -> Column:
    """F16: status colour, unknown -> critical red."""
    return F.coalesce(_literal_map(C.STATUS_COLORS)[col_(status)], F.lit(C.DEFAULT_STATUS_COLOR))


def cluster_compound_name(mean_code) -> Column:
    """Compound name of a cluster from its mean code, rounded half-even to an integer."""
    code = F.rint(col_(mean_code)).cast("int")
    return F.coalesce(_literal_map(C.CLUSTER_COMPOUND_NAMES)[code], F.lit(C.CLUSTER_COMPOUND_FALLBACK))


def cluster_label(compound_mean, tyre_mean, lap_mean, deg_mean) -> Column:
    """ordered rules on the rounded profile; suffix is the compound name."""
    name = cluster_compound_name(compound_mean)
    deg, tyre, lap = col_(deg_mean), col_(tyre_mean), col_(lap_mean)

    def fmt(template: str) -> Column:
        head, tail = template.split("{}")
        return F.concat(F.lit(head), name, F.lit(tail))

    return (F.when((deg > 15) & (tyre > 25), fmt(C.CLUSTER_LABEL_HIGH_DEG))
            .when(lap < -0.5, fmt(C.CLUSTER_LABEL_PACE))
            .when(tyre < 10, fmt(C.CLUSTER_LABEL_EARLY))
            .when(deg > 8, fmt(C.CLUSTER_LABEL_MODERATE))
            .otherwise(fmt(C.CLUSTER_LABEL_STABLE)))


def sanitize_label(label) -> Column:
    """metric-name sanitising: space -> underscore, 'Í' -> 'I'."""
    return F.translate(col_(label), " Í", "_I")
