"""Schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

#: Integer and float columns of a node, in the order of the node tables on disk.
NODE_INTS = ["label", "parent", "child1", "child2", "rank"]
NODE_FLOATS = ["pt", "rapidity", "phi", "energy", "px", "py", "pz", "join_distance", "size"]

PARTICLES = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("idx", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in ("px", "py", "pz", "energy", "pt", "rapidity", "phi")],
])
NODES = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("jet_id", T.LongType()),
    *[T.StructField(c, T.LongType()) for c in NODE_INTS], *[T.StructField(c, T.DoubleType()) for c in NODE_FLOATS],
])
#: Nodes with the outcome of their event: a failed event has one row, whose node columns are null.
CLUSTERED = T.StructType([*NODES.fields, T.StructField("status", T.StringType()), T.StructField("duration_s", T.DoubleType())])
#: Nodes with the first and the last step before which they are live, and the outcome of their event.
LIFETIMES = ["born", "last"]
LIVED = T.StructType([*CLUSTERED.fields, *[T.StructField(c, T.LongType()) for c in LIFETIMES]])
RUN_LOG = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("jet_name", T.StringType()), T.StructField("duration_s", T.DoubleType()), T.StructField("status", T.StringType())])
PARAMS = T.StructType([T.StructField(c, T.StringType()) for c in ("jet_name", "algorithm", "name", "value_json")])
