"""Angles as column expressions. NaN and infinite inputs give NaN, as in IEEE arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi
TURN = 2 * math.pi


def number(x: Column | str | float) -> Column:
    """A column, a column's name or a number as a double column."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def confine_angle(angle: Column | str) -> Column:
    """The angle in [-pi, pi)."""
    return F.pmod(number(angle) + PI, F.lit(TURN)) - PI


def raw_to_angular_distance(raw: Column | str) -> Column:
    """Shortest way around for a difference of angles, in [0, pi]."""
    raw = number(raw)
    # least() passes over NaN
    return F.when(F.isnan(raw), raw).otherwise(F.least(F.pmod(raw, F.lit(TURN)), F.pmod(-raw, F.lit(TURN))))


def angular_distance(a: Column | str, b: Column | str) -> Column:
    return raw_to_angular_distance(number(a) - number(b))
