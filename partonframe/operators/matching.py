"""Matching the events of two tables."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import depth, recursive_distance

KEY = "Event_n"


def _whole(kind: T.DataType) -> bool:
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def candidates(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    """(key, left_id, right_id, gap) of pairs with one key whose shared integer columns are equal; gap sums the
    distances of the shared float columns. Rows are named by their column ``event_id``; types come from the schema."""
    shared = [c for c in left.columns if c in right.columns and c not in (key, "event_id")]
    l = left.select(F.col(key), F.col("event_id").alias("left_id"), *[F.col(c).alias(f"l_{c}") for c in shared])
    r = right.select(F.col(key), F.col("event_id").alias("right_id"), *[F.col(c).alias(f"r_{c}") for c in shared])
    gap: Column = F.lit(0.0)
    same: list[Column] = []
    for c in shared:
        kind = left.schema[c].dataType
        if _whole(kind):
            same.append(F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")))
        else:
            gap = gap + recursive_distance(F.col(f"l_{c}"), F.col(f"r_{c}"), depth(left, c))
    # equal scalars can take part in the join itself
    on = l[key] == r[key]
    joined = l.join(r, reduce(Column.__and__, same, on)).drop(r[key])
    return joined.select(key, "left_id", "right_id", gap.alias("gap")).where(~F.isnan("gap") & (F.col("gap") < float("inf")))


def _greedy(group: pd.DataFrame) -> pd.DataFrame:
    taken_l, taken_r, out = set(), set(), []
    for row in group.sort_values(["gap", "left_id", "right_id"]).itertuples(index=False):
        if row.left_id not in taken_l and row.right_id not in taken_r:
            taken_l.add(row.left_id)
            taken_r.add(row.right_id)
            out.append((row.left_id, row.right_id))
    return pd.DataFrame(out, columns=["left_id", "right_id"], dtype="int64")


def match_events(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    """(left_id, right_id) of every left event; -1 where nothing matches.

    The least gap is matched first, each event once; ties go to the least ids. Candidates never cross keys,
    so the assignment runs per key; candidates that are the only one of both their events need none.
    """
    found = candidates(left, right, key)
    rivals = F.greatest(*[F.count(F.lit(1)).over(Window.partitionBy(key, c)) for c in ("left_id", "right_id")])
    counted = found.withColumn("rivals", rivals)
    single = counted.where("rivals = 1").select("left_id", "right_id")
    # an event with rivals competes with candidates of its rivals only, all of which have rivals themselves
    several = counted.where("rivals > 1").select(key, "left_id", "right_id", "gap").groupBy(key).applyInPandas(_greedy, "left_id long, right_id long")
    pairs = single.select(F.col("left_id").cast("long"), F.col("right_id").cast("long")).union(several)
    return left.select(F.col("event_id").cast("long").alias("left_id")).join(pairs, "left_id", "left").withColumn("right_id", F.coalesce("right_id", F.lit(-1).cast("long")))
