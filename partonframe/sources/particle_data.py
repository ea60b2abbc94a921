"""The table of particle identities, and names of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Attributes of an entry and their types.
ATTRIBUTES = {"id": "bigint", "name": "string", "antiName": "string", "spinType": "int", "chargeType": "int", "colType": "int", "m0": "double", "mWidth": "double", "mMin": "double", "mMax": "double", "tau0": "double"}


def read_identities(spark: SparkSession, path: str) -> DataFrame:
    """Lines with name="value" pairs, one particle a line."""
    return parse_identities(spark.read.text(path))


def parse_identities(lines: DataFrame) -> DataFrame:
    pairs = F.regexp_extract_all("value", F.lit(r'(\w+)="([^"]*)"'), F.lit(1)), F.regexp_extract_all("value", F.lit(r'(\w+)="([^"]*)"'), F.lit(2))
    found = lines.select(F.map_from_arrays(*pairs).alias("m")).where(F.map_contains_key("m", F.lit("id")))
    return found.select(*[F.expr(f"try_cast(m['{a}'] as {t})").alias(a) for a, t in ATTRIBUTES.items()])


def with_antiparticles(identities: DataFrame) -> DataFrame:
    """(pid, name, charge, spin, m0) of particles and antiparticles: charge in thirds, spin (spinType - 1) / 2, null where unknown."""
    spin = F.when(F.col("spinType") > 0, (F.col("spinType") - 1) / 2)
    one = identities.select(F.col("id").alias("pid"), "name", (F.col("chargeType") / 3).alias("charge"), spin.alias("spin"), "m0")
    anti = identities.where(F.col("antiName").isNotNull()).select((-F.col("id")).alias("pid"), F.col("antiName").alias("name"), (-F.col("chargeType") / 3).alias("charge"), spin.alias("spin"), "m0")
    return one.union(anti)


def names(pids: DataFrame, table: DataFrame, pid: str = "pid") -> DataFrame:
    """``pids`` with the name of each id, the id itself where it is unknown. The table of identities is a fixed dimension of some hundred rows."""
    joined = pids.join(F.broadcast(table.select(F.col("pid").alias("_pid"), "name")), F.col(pid) == F.col("_pid"), "left").drop("_pid")
    return joined.withColumn("name", F.coalesce("name", F.col(pid).cast("string")))


def match(name: Column, desired: str, partial: bool = True) -> Column:
    """Whether a name contains what is looked for, or equals it."""
    return F.contains(name, F.lit(desired)) if partial else name == desired
