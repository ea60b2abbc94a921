"""Event tables in Parquet: long tables of particles, and an importer of one-record ragged files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import depth


def to_long(events: DataFrame, columns: list[str]) -> DataFrame:
    """A row for every element of equally long list columns: event_id, idx and the columns."""
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    return events.select("event_id", F.posexplode(zipped).alias("idx", "x")).select("event_id", F.col("idx").cast("long").alias("idx"), *[F.col("x").getField(c).alias(c) for c in columns])


def _field(name: str):
    return lambda x: x[name]


def to_wide(particles: DataFrame, columns: list[str]) -> DataFrame:
    """A row for every event, the columns as lists by idx."""
    rows = particles.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("idx", *columns))).alias("x"))
    return rows.select("event_id", *[F.transform("x", _field(c)).alias(c) for c in columns])


def import_record(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, object]]:
    """(table, values) of a file whose single record holds every column as a pair [tag, payload].

    Columns of lists become columns of a table by event; tagged strings and scalars become values.
    """
    record = spark.read.parquet(path)
    tables, values = [], {}
    for name in record.columns:
        kind = record.schema[name].dataType
        if not isinstance(kind, T.ArrayType):
            continue
        if isinstance(kind.elementType, T.ArrayType) and depth(record, name) >= 2 and not isinstance(kind.elementType.elementType, T.StringType):
            tables.append(record.select(F.posexplode(F.element_at(name, 2)).alias("event_id", name)).withColumn("event_id", F.col("event_id").cast("long")))
            continue
        tag, payload = record.select(F.element_at(name, 1), F.element_at(name, 2)).first()
        values[name] = _value(tag[0] if isinstance(tag, list) and tag else tag, payload)
    out = None
    for t in tables:
        out = t if out is None else out.join(t, "event_id", "full")
    return out if out is not None else spark.createDataFrame([], "event_id long"), values


def _value(tag: object, payload: object) -> object:
    text = payload[0] if isinstance(payload, list) and len(payload) == 1 else payload
    if tag == "string_str":
        return text
    if tag == "list_str":
        return list(payload) if isinstance(payload, list) else [payload]
    special = {"None": None, "True": True, "False": False, "nan": float("nan"), "inf": float("inf"), "-inf": float("-inf")}
    if text in special:
        return special[text]  # type: ignore[index]
    for kind in (int, float):
        try:
            return kind(text)  # type: ignore[arg-type]
        except (TypeError, ValueError):
            pass
    return text
