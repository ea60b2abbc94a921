"""Joins and running sums that stay even when one key holds a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key with at least this fraction of the rows is hot, so at most this many keys are.
HOT_PARTS = 256


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality on every name."""
    return reduce(Column.__and__, [left[n].eqNullSafe(right[n]) for n in names])


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], n: str, total: int, spread: Column, how: str = "inner") -> DataFrame:
    """Join ``many`` to ``one``, which has one row per key and in ``n`` the rows of ``many`` with that key.

    Keys with over 1/HOT_PARTS of the ``total`` rows (so HOT_PARTS of them at most, whatever the input)
    are broadcast with their number of salts; their rows are dealt by ``spread``, and only their rows of
    ``one`` are repeated, once per salt.
    """
    cut = max(1000, total // HOT_PARTS)
    salts = (F.floor(F.col(n) / F.lit(cut)) + 1).cast("int")
    hot = one.where(F.col(n) >= cut).select(*[F.col(k).alias(f"_h_{k}") for k in keys], salts.alias("_salts"))
    match = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys])
    dealt = many.join(F.broadcast(hot), match, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts").cast("long")), F.lit(0)).cast("int"))
    dealt = dealt.drop("_salts", *[f"_h_{k}" for k in keys])
    copies = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(n) >= cut, salts - 1).otherwise(0))))
    copies = copies.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_salt").alias("_o_salt"), *[c for c in one.columns if c not in keys])
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys] + [F.col("_salt") == F.col("_o_salt")])
    return dealt.join(copies, on, how).drop("_salt", "_o_salt", *[f"_o_{k}" for k in keys])


def in_order(df: DataFrame, order: list[Column], bucket: str) -> DataFrame:
    """``df`` with a bucket whose numbers follow the order, however few values its first columns have.

    To be written before it is used: a second run may draw other borders.
    """
    return df.repartitionByRange(*order).withColumn(bucket, F.spark_partition_id().cast("long"))


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same group, in the order (bucket, order).

    A group of any size is summed bucket by bucket: one small table of bucket sums gets a running sum,
    and rows are ordered only within their bucket.
    """
    valued = df.withColumn("_v", value)
    sums = valued.groupBy(*group, bucket).agg(F.sum("_v").alias("_s"))
    over = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_before", F.coalesce(F.sum("_s").over(over), F.lit(0))).drop("_s")
    starts = starts.select(*[F.col(c).alias(f"_r_{c}") for c in [*group, bucket]], "_before")
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = valued.withColumn("_within", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in [*group, bucket]])
    return ranked.join(starts, on).withColumn(out, F.col("_before") + F.col("_within")).drop("_v", "_within", "_before", *[f"_r_{c}" for c in [*group, bucket]])
