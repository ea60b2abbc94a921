"""Algorithms, their parameters, defaults and permitted values; all checks run on the driver before any job."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PARAMS

POSITIVE, NATURAL, REAL, BOOL = "positive definite number", "natural number", "real number", "bool"
#: Default and permitted values of every parameter of every algorithm.
REGISTRY: dict[str, dict[str, tuple[object, list[object]]]] = {
    "GeneralisedKT": {
        "DeltaR": (0.8, [POSITIVE]),
        "ExpofPTInput": (0.0, [REAL]),
        "ExpofPTFormatInput": (None, [None, "genkt", "ratiokt"]),
        "PhyDistance": ("angular", ["angular"]),
    },
    "Spectral": {
        "MaxMeanDist": (1.26, [None, POSITIVE]),
        "MaxMinDist": (None, [None, POSITIVE]),
        "ExpofPTInput": (0.0, [REAL]),
        "ExpofPTAffinity": (0.0, [REAL]),
        "ExpofPTEmbedding": (0.0, [REAL]),
        "ExpofPTFormatInput": (None, [None, "genkt", "ratiokt", "suppressedkt"]),
        "ExpofPTFormatAffinity": (None, [None, "genkt", "ratiokt", "suppressedkt"]),
        "ExpofPTFormatEmbedding": (None, [None, "genkt", "ratiokt", "suppressedkt"]),
        "PhyDistance": ("angular", ["angular"]),
        "EmbedDistance": ("root_angular", ["euclidiean", "angular", "root_angular"]),
        "EmbedHardness": (None, ["pt", None]),
        "Laplacian": ("symmetric_carried", ["unnormed", "symmetric", "pt", "symmetric_carried"]),
        "ExpofPhysDistance": (2.0, [POSITIVE]),
        "EigenvalueLimit": (0.4, [POSITIVE]),
        "Sigma": (0.15, [POSITIVE]),
        "CutoffKNN": (5, [None, NATURAL]),
        "Beta": (1.4, [REAL]),
        "ClipBeta": (1e-3, [POSITIVE]),
        "SingularitySuppression": (0.0001, [None, POSITIVE]),
    },
    "Wavelet": {
        "Sigma": (0.1, [POSITIVE]),
        "Cutoff": (0.0, [REAL]),
        "NRounds": (15, [NATURAL]),
        "Normalised": (True, [BOOL]),
    },
    "IterativeCone": {
        "DeltaR": (0.8, [POSITIVE]),
        "SeedThreshold": (1.0, [POSITIVE]),
        "ExpofPTInput": (0.0, [REAL]),
        "ExpofPTFormatInput": (None, [None, "genkt", "ratiokt"]),
        "PhyDistance": ("angular", ["angular"]),
    },
    "Manual": {},
}
REGISTRY["SpectralMean"] = REGISTRY["Spectral"]
#: Other names of the heat wavelets.
REGISTRY["CALE"] = REGISTRY["CALECpp"] = REGISTRY["Wavelet"]
#: Cuts of the jet selection.
JET_CUTS = {"lead": 30.0, "other": 30.0, "light_lead": 20.0, "light_other": 15.0, "light_mass": 120.0, "tracks": 2}


def is_numeric_class(value: object, kind: str) -> bool:
    """Whether a value is of a numeric class; infinity is positive definite, NaN is a real number only."""
    if isinstance(value, bool) or value is None:
        return kind == BOOL and isinstance(value, bool)
    if kind == NATURAL:
        return isinstance(value, int) and value > 0
    try:
        number = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return False
    return kind == REAL or kind == POSITIVE and number > 0


def defaults(algorithm: str) -> dict[str, object]:
    return {name: default for name, (default, _) in REGISTRY[algorithm].items()}


def check_params(algorithm: str, params: Mapping[str, object] | None) -> dict[str, object]:
    """All parameters of an algorithm, given ones checked; ValueError for an unknown name or a value that isn't permitted."""
    if algorithm not in REGISTRY:
        raise ValueError(f"unknown algorithm {algorithm!r}; there are {sorted(REGISTRY)}")
    known = REGISTRY[algorithm]
    for name, value in (params or {}).items():
        if name not in known:
            raise ValueError(f"{algorithm} has no parameter {name!r}")
        classes = {POSITIVE, NATURAL, REAL, BOOL}
        permitted = known[name][1]
        exact = any(type(value) is type(p) and value == p or value is None and p is None for p in permitted if p not in classes)
        if not exact and not any(is_numeric_class(value, p) for p in permitted if p in classes):
            raise ValueError(f"{value!r} isn't permitted for {name} of {algorithm}: {permitted}")
    return defaults(algorithm) | dict(params or {})


@lru_cache(maxsize=1)
def all_param_names() -> tuple[str, ...]:
    return tuple(sorted({n for p in REGISTRY.values() for n in p}))


def jet_name(name: str) -> str:
    return name if name.endswith("Jet") else f"{name}Jet"


def params_table(spark: SparkSession, name: str, algorithm: str, params: Mapping[str, object]) -> DataFrame:
    return spark.createDataFrame([(jet_name(name), algorithm, k, json.dumps(v)) for k, v in sorted(params.items())], PARAMS)


def stored_params(table: DataFrame, name: str, add_defaults: bool = False) -> dict[str, object]:
    """Parameters that were stored for a jet; a table of one row per parameter."""
    rows = table.where(F.col("jet_name") == jet_name(name)).collect()
    found = {r["name"]: json.loads(r["value_json"]) for r in rows}
    return defaults(rows[0]["algorithm"]) | found if add_defaults and rows else found


def jet_names(table: DataFrame) -> list[str]:
    return [r[0] for r in table.select("jet_name").distinct().orderBy("jet_name").collect()]


def same_params(stored: Mapping[str, object], now: Mapping[str, object]) -> bool:
    """Whether two sets of parameters agree, numbers within rounding."""

    def same(a: object, b: object) -> bool:
        if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
            return math.isclose(a, b, rel_tol=1e-5, abs_tol=1e-8) or math.isnan(a) and math.isnan(b)
        return a == b

    return set(stored) == set(now) and all(same(stored[k], now[k]) for k in stored)
