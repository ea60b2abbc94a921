"""Derived kinematic columns: transverse momentum, angles, rapidities, mass.

Columns of one set of objects share a prefix: ``Track_Px``, ``Track_Py``; an empty prefix has no underscore.
The ``add_*`` functions find every prefix whose inputs are there and whose output isn't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .angles import PI, confine_angle, number

INF = float("inf")
NAN = float("nan")


def pt(px: Column | str, py: Column | str) -> Column:
    px, py = number(px), number(py)
    return F.sqrt(px * px + py * py)


def phi(px: Column | str, py: Column | str) -> Column:
    return F.atan2(number(py), number(px))


def theta(pt: Column | str, pz: Column | str) -> Column:
    return F.atan2(number(pt), number(pz))


def theta_from_momentum(momentum: Column | str, pz: Column | str) -> Column:
    momentum, pz = number(momentum), number(pz)
    return F.when(momentum == 0, F.lit(NAN)).otherwise(F.acos(F.try_divide(pz, momentum)))


def rapidity(pt: Column | str, pz: Column | str, energy: Column | str) -> Column:
    """sign(pz) / 2 * ln((pt^2 + m^2) / (E - |pz|)^2), m^2 at least 0; 0 at pz = 0; infinite along the beam."""
    pt, pz, energy = number(pt), number(pz), number(energy)
    sign = F.when(pz < 0, -1.0).when(pz > 0, 1.0).otherwise(pz)
    rest2 = energy * energy - pz * pz - pt * pt
    top = pt * pt + F.when(F.isnan(rest2), rest2).otherwise(F.greatest(rest2, F.lit(0.0)))
    gap = energy - F.abs(pz)
    low = gap * gap
    inside = 0.5 * F.log(F.try_divide(top, low))
    value = (
        F.when(F.isnan(pt) | F.isnan(pz) | F.isnan(energy), NAN).when((pz == 0) & (pt == 0) & (energy == 0), NAN).when(pz == 0, 0.0)
        .when((low == 0) & (top == 0), sign * INF).when(low == 0, sign * INF).when(top == 0, sign * -INF).otherwise(sign * inside)
    )
    return value


def pseudorapidity(theta: Column | str) -> Column:
    """-ln tan(theta / 2), infinite at 0 and pi."""
    theta = number(theta)
    confined = confine_angle(theta)
    # the smaller of the angles with either half of the beam line; a theta of pi is confined to -pi
    near = F.abs(F.least(confined, PI - confined))
    sign = F.when(theta > PI / 2, -1.0).otherwise(1.0)
    return F.when(F.isnan(theta), theta).when(theta == 0, INF).when(theta == PI, -INF).otherwise(sign * -F.log(F.tan(near / 2)))


def mass2(energy: Column | str, px: Column | str, py: Column | str, pz: Column | str) -> Column:
    energy, px, py, pz = map(number, (energy, px, py, pz))
    return energy * energy - px * px - py * py - pz * pz


def mass(energy: Column | str, px: Column | str, py: Column | str, pz: Column | str) -> Column:
    """NaN where the momentum exceeds the energy."""
    return F.sqrt(mass2(energy, px, py, pz))


def px_py_pz(energy: Column | str, pt: Column | str, rapidity: Column | str, phi: Column | str) -> tuple[Column, Column, Column]:
    pt, phi = number(pt), number(phi)
    return pt * F.cos(phi), pt * F.sin(phi), number(energy) * F.tanh(number(rapidity))


def big_to_inf(x: Column | str, most: float = 999.0) -> Column:
    """Values beyond +-most mean infinity in some detector files."""
    x = number(x)
    return F.when(x > most, INF).when(x < -most, -INF).otherwise(x)


def join_prefix(prefix: str, name: str) -> str:
    return f"{prefix}_{name}" if prefix else name


def prefixes(columns: Iterable[str], has: Iterable[str], lacks: str | None = None) -> list[str]:
    """Prefixes, '' included, of which all the columns ``has`` are there and ``lacks`` isn't; sorted."""
    names, has = set(columns), list(has)
    found = {c[: -len(has[0])].removesuffix("_") for c in names if c == has[0] or c.endswith(f"_{has[0]}")}
    return sorted(p for p in found if all(join_prefix(p, h) in names for h in has) and (lacks is None or join_prefix(p, lacks) not in names))


def _each(df: DataFrame, out: str, needs: list[str], formula: Callable[..., Column], only: str | Iterable[str] | None, elementwise: int) -> DataFrame:
    wanted = prefixes(df.columns, needs, out) if only is None else [only] if isinstance(only, str) else list(only)
    new = {}
    for p in wanted:
        inputs = [F.col(f"`{join_prefix(p, n)}`") for n in needs]
        new[join_prefix(p, out)] = _lift(formula, inputs, elementwise)
    return df.withColumns(new) if new else df


def _lift(formula: Callable[..., Column], inputs: list[Column], depth: int) -> Column:
    """The formula on scalars, or on the elements of arrays nested ``depth`` deep."""
    if not depth:
        return formula(*inputs)
    zipped = F.arrays_zip(*[x.alias(f"x{i}") for i, x in enumerate(inputs)])
    return F.transform(zipped, lambda s: _lift(formula, [s[f"x{i}"] for i in range(len(inputs))], depth - 1))


def add_pt(df: DataFrame, prefix=None, depth: int = 0) -> DataFrame:
    return _each(df, "PT", ["Px", "Py"], pt, prefix, depth)


def add_phi(df: DataFrame, prefix=None, depth: int = 0) -> DataFrame:
    return _each(df, "Phi", ["Px", "Py"], phi, prefix, depth)


def add_theta(df: DataFrame, prefix=None, depth: int = 0) -> DataFrame:
    """From the momentum and Pz (``Birr``) where both are there, else from PT, else from Px and Py; skipped where none will do."""
    for needs, formula in (
        (["Birr", "Pz"], theta_from_momentum),
        (["PT", "Pz"], theta),
        (["Px", "Py", "Pz"], lambda x, y, z: theta(pt(x, y), z)),
    ):
        able = prefixes(df.columns, needs, "Theta")
        wanted = able if prefix is None else [p for p in ([prefix] if isinstance(prefix, str) else prefix) if p in able]
        df = _each(df, "Theta", needs, formula, wanted, depth)
    return df


def add_rapidity(df: DataFrame, prefix=None, depth: int = 0) -> DataFrame:
    return _each(df, "Rapidity", ["PT", "Pz", "Energy"], rapidity, prefix, depth)


def add_pseudorapidity(df: DataFrame, prefix=None, depth: int = 0) -> DataFrame:
    return _each(df, "PseudoRapidity", ["Theta"], pseudorapidity, prefix, depth)


def add_mass(df: DataFrame, prefix=None, depth: int = 0) -> DataFrame:
    return _each(df, "Mass", ["Energy", "Px", "Py", "Pz"], mass, prefix, depth)


def add_all(df: DataFrame, prefix=None, with_mass: bool = False, depth: int = 0) -> DataFrame:
    for step in (add_theta, add_pt, add_phi, add_rapidity, add_pseudorapidity, *([add_mass] if with_mass else [])):
        df = step(df, prefix, depth)
    return df
