"""Factors of pair distances and affinities, for the two particles of a pair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import angular_distance, number


def ca_distance2(rapidity1, phi1, rapidity2, phi2) -> Column:
    """Squared distance in rapidity and azimuth."""
    dphi, dy = angular_distance(phi1, phi2), number(rapidity1) - number(rapidity2)
    return dphi * dphi + dy * dy


def genkt_factor(exponent: float, pt1, pt2) -> Column:
    return F.least(F.pow(number(pt1), F.lit(float(exponent))), F.pow(number(pt2), F.lit(float(exponent))))


def ratiokt_factor(exponent: float, pt1, pt2) -> Column:
    one, two = F.pow(number(pt1), F.lit(float(exponent))), F.pow(number(pt2), F.lit(float(exponent)))
    return F.try_divide(F.least(one, two), F.greatest(one, two))


def hyperbolic_suppression(constant: float, value) -> Column:
    return 1.0 - F.try_divide(F.lit(float(constant)), F.lit(float(constant)) + number(value))


def suppressedkt_factor(constant: float, pt1, pt2) -> Column:
    return hyperbolic_suppression(constant, F.least(number(pt1), number(pt2)))


def singularity_factor(constant: float, distance2, pt1, pt2) -> Column:
    """Suppression of soft and collinear pairs: hyperbolic in min(pt) times the distance."""
    return hyperbolic_suppression(constant, F.least(number(pt1), number(pt2)) * F.sqrt(number(distance2)))


def factor(form: str | None, exponent: float, pt1, pt2) -> Column:
    """The factor named by a PT format; 1 without one."""
    if form is None:
        return F.lit(1.0)
    return {"genkt": genkt_factor, "ratiokt": ratiokt_factor, "suppressedkt": suppressedkt_factor}[form](exponent, pt1, pt2)


def generalised_kt_distance2(pt1, rapidity1, phi1, pt2, rapidity2, phi2, exponent: float) -> Column:
    f = genkt_factor(exponent, pt1, pt2)
    return ca_distance2(rapidity1, phi1, rapidity2, phi2) * f * f


METRICS = {"antikt": -1.0, "cambridge_aachen": 0.0, "kt": 1.0}


def named_distance2(pt1, rapidity1, phi1, pt2, rapidity2, phi2, metric: str) -> Column:
    return generalised_kt_distance2(pt1, rapidity1, phi1, pt2, rapidity2, phi2, METRICS[metric])


def exp_affinity(distance2, sigma: float = 1.0, exponent: float = 2.0) -> Column:
    return F.exp(-F.pow(number(distance2), F.lit(exponent / 2)) / F.lit(float(sigma)))


def heat_kernel(x, kind: str = "mh") -> Column:
    """x exp(-x), the only kernel there is."""
    if kind != "mh":
        raise ValueError(f"unknown kernel {kind!r}")
    return number(x) * F.exp(-number(x))


def antikt_weight(rapidity1, phi1, pt1, rapidity2, phi2, pt2) -> Column:
    """Distance times min(1/pt): low where hard neighbours are near; seeds are taken in its order."""
    near = F.sqrt(ca_distance2(rapidity1, phi1, rapidity2, phi2))
    return near * F.least(F.try_divide(F.lit(1.0), number(pt1)), F.try_divide(F.lit(1.0), number(pt2)))
