"""Checks of event tables: impossible momenta, uneven columns, columns without content."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinematics import join_prefix, mass2, prefixes


def tachyons(df: DataFrame, relaxation: float = 0.0001, ignore: Iterable[str] = ()) -> list[str]:
    """Prefixes with a particle whose E^2 - p^2 is below -relaxation, or NaN. One aggregate over all of them."""
    found = [p for p in prefixes(df.columns, ["Energy", "Px", "Py", "Pz"]) if p not in set(ignore)]
    if not found:
        return []
    rest = {p: mass2(*[F.col(join_prefix(p, c)) for c in ("Energy", "Px", "Py", "Pz")]) for p in found}
    row = df.agg(*[F.coalesce(F.bool_or(F.isnan(rest[p]) | (rest[p] < -relaxation)), F.lit(False)).alias(f"b{i}") for i, p in enumerate(found)]).first()
    return [p for i, p in enumerate(found) if row[f"b{i}"]]


def drop_tachyons(df: DataFrame, raise_error: bool = False, relaxation: float = 0.0001, ignore: Iterable[str] = ()) -> DataFrame:
    """The table without the columns of such prefixes; ValueError instead if asked for."""
    bad = tachyons(df, relaxation, ignore)
    if bad and raise_error:
        raise ValueError(f"impossible momenta in {bad}")
    gone = [c for c in df.columns for p in bad if (c.startswith(f"{p}_") if p else c in ("Energy", "Px", "Py", "Pz"))]
    return df.drop(*gone)


def uneven(tables: dict[str, DataFrame], ignore: Iterable[str] = ()) -> dict[str, int]:
    """Names of column tables (each with event_id) that have fewer events than the longest, and how many they have."""
    counts = {n: df.select("event_id").distinct().count() for n, df in tables.items() if n.split("_")[0] not in set(ignore)}
    most = max(counts.values(), default=0)
    return {n: k for n, k in counts.items() if k < most}


def drop_uneven(tables: dict[str, DataFrame], raise_error: bool = False, ignore: Iterable[str] = ()) -> dict[str, DataFrame]:
    """The tables without uneven ones and those that share their prefix."""
    bad = uneven(tables, ignore)
    if bad and raise_error:
        raise ValueError(f"uneven columns: {bad}")
    gone = {n.split("_")[0] for n in bad}
    return {n: df for n, df in tables.items() if n.split("_")[0] not in gone}


def phantom_columns(declared: Iterable[str], df: DataFrame) -> list[str]:
    """Declared columns without content."""
    return [c for c in declared if c not in set(df.columns)]
