"""Jets from node tables: recombination of given groups, trees, splitting, selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kinematics as K
from ..functions.angles import confine_angle
from ..plans.params import JET_CUTS
from ..schema import NODES
from .batches import whole_events


def create_jets(particles: DataFrame, group: str = "jet_id") -> DataFrame:
    """Node table of given groups: leaves keep their index as label, each group gets a root with the summed momenta.

    Roots are their own children, have rank 0 and no join distance; they are numbered after the event's
    particles, in order of their group. A particle with a null group stays without parent.
    """
    every = particles.withColumn("_g", F.col(group).cast("long"))
    if not {"pt", "rapidity", "phi"} <= set(every.columns):
        every = every.withColumns({"pt": K.pt("px", "py"), "phi": K.phi("px", "py")}).withColumn("rapidity", K.rapidity("pt", "pz", "energy"))
    # windows within the event, so that particles are read and dealt by event once
    event, each = Window.partitionBy("event_id"), Window.partitionBy("event_id", "_g")
    place = F.dense_rank().over(event.orderBy(F.col("_g").asc_nulls_last()))
    every = every.withColumns({"_last": F.max("idx").over(event), "_place": place})
    sums = {f"_{c}": F.sum(c).over(each) for c in ("energy", "px", "py", "pz")}
    every = every.withColumns({"_first": F.row_number().over(each.orderBy("idx")) == 1, "_size": F.count(F.lit(1)).over(each).cast("double"), **sums})
    every = every.withColumn("_root", F.when(F.col("_g").isNotNull(), F.col("_last") + F.col("_place")))
    every = every.withColumns({"_pt": K.pt("_px", "_py"), "_phi": K.phi("_px", "_py")}).withColumn("_rapidity", K.rapidity("_pt", "_pz", "_energy"))
    none, nan = F.lit(-1).cast("long"), F.lit(float("nan"))
    names = [c for c in NODES.fieldNames() if c != "event_id"]
    own = {"jet_id": F.coalesce("_root", "idx"), "label": F.col("idx"), "parent": F.coalesce("_root", none), "child1": none, "child2": none, "rank": none, "join_distance": F.lit(0.0), "size": F.lit(1.0)}
    made = {"jet_id": F.col("_root"), "label": F.col("_root"), "parent": none, "child1": F.col("_root"), "child2": F.col("_root"), "rank": F.lit(0).cast("long"), "join_distance": nan}
    leaf = F.struct(*[own.get(c, F.col(c)).alias(c) for c in names])
    root = F.struct(*[made.get(c, F.col(f"_{c}")).alias(c) for c in names])
    nodes = F.when(F.col("_first") & F.col("_root").isNotNull(), F.array(leaf, root)).otherwise(F.array(leaf))
    found = every.select("event_id", F.explode(nodes).alias("n")).select("event_id", *[F.col(f"n.{c}").alias(c) for c in names])
    return found.withColumn("phi", confine_angle("phi"))


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.where("child1 = -1")


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent = -1")


def jets(nodes: DataFrame) -> DataFrame:
    """One row per jet: momentum of the root and number of leaves."""
    root = F.max_by(F.struct("pt", "rapidity", "phi", "energy", "px", "py", "pz", "size"), F.when(F.col("parent") == -1, 1).otherwise(0)).alias("root")
    return nodes.groupBy("event_id", "jet_id").agg(root, F.count_if(F.col("child1") == -1).alias("n_leaves"), F.count(F.lit(1)).alias("n_nodes")).select("event_id", "jet_id", "root.*", "n_leaves", "n_nodes")


def by_pt(jets: DataFrame) -> DataFrame:
    """``jets`` with their place in their event, the hardest first, ties by jet id."""
    return jets.withColumn("place", F.row_number().over(Window.partitionBy("event_id").orderBy(F.col("pt").desc(), "jet_id")) - 1)


def nested(nodes: DataFrame) -> DataFrame:
    """One row per event, every node column as a list of jets of lists of nodes, by jet and label."""
    names = [c for c in nodes.columns if c not in ("event_id", "jet_id")]
    each = nodes.groupBy("event_id", "jet_id").agg(F.sort_array(F.collect_list(F.struct("label", *[c for c in names if c != "label"]))).alias("n"))
    whole = each.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("jet_id", "n"))).alias("j"))
    return whole.select("event_id", *[F.transform("j", _inner(c)).alias(c) for c in names])


def _inner(name: str):
    """A list's elements of one name, for each list."""
    return lambda x: F.transform(x["n"], lambda y: y[name])


def from_nested(table: DataFrame) -> DataFrame:
    """The node table of a nested one; a jet's id is the label of its root."""
    names = [c for c in table.columns if c != "event_id"]
    jets = table.select("event_id", F.explode(F.arrays_zip(*names)).alias("j"))
    rows = jets.select("event_id", F.filter(F.arrays_zip(F.col("j.label"), F.col("j.parent")), lambda x: x["parent"] == -1)[0]["label"].alias("jet_id"), F.explode(F.arrays_zip(*[F.col(f"j.{c}") for c in names])).alias("n"))
    return rows.select("event_id", "jet_id", *[F.col(f"n.{c}") for c in names])


def interval_labels(nodes: DataFrame, clustered: bool = False) -> DataFrame:
    """(event_id, label, leaf, enter, last, n_leaves): places of nodes in their event's trees, depth first, the last place
    below each, and the leaves there, itself if it is one.

    What is below a node has places in (enter, last], so descent is a comparison and takes no walk, however deep a tree
    is. Trees are told by parents alone; siblings and roots go by label. Nodes that no root leads to, those of a cycle
    or below a parent that isn't there, have null places. ``clustered`` is as in :func:`cluster.cluster`.
    """
    schema = "event_id bigint, label bigint, leaf boolean, enter bigint, last bigint, n_leaves bigint"
    rows = nodes.select(F.col("event_id").cast("long"), F.col("label").cast("long"), F.col("parent").cast("long"), (F.col("child1") == -1).alias("leaf"))
    dealt = rows if clustered else rows.repartition("event_id")
    return dealt.sortWithinPartitions("event_id", "label").mapInArrow(_numbered, schema)


def _numbered(batches: Iterator[pa.RecordBatch], rows_out: int = 50_000) -> Iterator[pa.RecordBatch]:
    return map(_places, whole_events(batches, rows_out))


def _places(table: pa.Table) -> pa.RecordBatch:
    """The places of all nodes of some events (rows by event and label), level by level of all trees at once."""
    event, label, parent = (table[c].to_numpy() for c in ("event_id", "label", "parent"))
    leaf = table["leaf"].to_numpy(zero_copy_only=False).astype(bool)
    n = len(label)
    first = np.r_[True, event[1:] != event[:-1]]
    which = np.cumsum(first) - 1
    # (event, label) as one number that ascends with the rows
    known, place = np.unique(label, return_inverse=True)
    at = np.searchsorted(known, parent)
    there = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == parent) & (parent != -1)
    key, asked = which * len(known) + place, which * len(known) + at
    up = np.minimum(np.searchsorted(key, asked), n - 1)
    up = np.where(there & (key[up] == asked), up, -1)
    root = parent == -1
    # levels from the roots; rows by parent, of which the children are a range each
    order = np.argsort(up, kind="stable")
    lo, hi = np.searchsorted(up[order], np.arange(n), "left"), np.searchsorted(up[order], np.arange(n), "right")
    levels, seen = [np.flatnonzero(root)], root.copy()
    while len(levels[-1]):
        counts = (hi - lo)[levels[-1]]
        below = order[np.repeat(lo[levels[-1]] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        seen[below] = True
        levels.append(below)
    size, leaves = seen.astype(np.int64), (leaf & seen).astype(np.int64)
    for rows in levels[:0:-1]:
        np.add.at(size, up[rows], size[rows])
        np.add.at(leaves, up[rows], leaves[rows])
    # a node comes after its parent and the trees of siblings of lesser label, a root after those of lesser roots
    enter = np.zeros(n, np.int64)
    for k, rows in enumerate(levels):
        if not len(rows):
            continue
        group = up[rows] if k else which[rows]
        before = np.cumsum(size[rows]) - size[rows]
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        enter[rows] = before - np.repeat(before[heads], np.diff(np.r_[heads, len(rows)])) + (enter[group] + 1 if k else 0)
    null = ~seen
    columns = [pa.array(x, pa.int64(), mask=null) for x in (enter, enter + size - 1, leaves)]
    return pa.RecordBatch.from_arrays([pa.array(event), pa.array(label), pa.array(leaf), *columns], ["event_id", "label", "leaf", "enter", "last", "n_leaves"])


def descendants(nodes: DataFrame, start: DataFrame, last_only: bool = True) -> DataFrame:
    """(event_id, start, label) of the nodes below each start (event_id, label); the leaves only, a start that is one
    included, or all but the start. A range join of places within the event."""
    places = interval_labels(nodes)
    asked = start.select("event_id", F.col("label").alias("start")).distinct()
    own = places.select("event_id", F.col("label").alias("start"), F.col("enter").alias("_from"), F.col("last").alias("_to"))
    below = asked.join(own, ["event_id", "start"]).join(places, "event_id").where(F.col("enter").between(F.col("_from"), F.col("_to")))
    return below.where("leaf" if last_only else "label != start").select("event_id", "start", "label")


def leaf_counts(nodes: DataFrame, clustered: bool = False) -> DataFrame:
    """(event_id, label, n_leaves): leaves below every node, itself if it is one; ``clustered`` is as in :func:`cluster.cluster`."""
    return interval_labels(nodes, clustered).where("enter is not null").select("event_id", "label", "n_leaves")


def merge_sequence(nodes: DataFrame) -> DataFrame:
    """Merges in order: (event_id, step, child1, child2, label)."""
    merged = nodes.where("child1 != -1").select("event_id", "child1", "child2", "label")
    return merged.withColumn("step", F.row_number().over(Window.partitionBy("event_id").orderBy("label")) - 1).select("event_id", "step", "child1", "child2", "label")


def filter_jets(jets: DataFrame, min_jetpt: float | None = None, min_ntracks: int | None = None, light: bool | DataFrame = False) -> DataFrame:
    """Jets (event_id, jet_id, pt, n_leaves) of good events: the hardest is above the lead cut; those above the
    other cut with enough leaves stay.

    ``min_jetpt`` sets both cuts. ``light`` chooses the lower default cuts: a truth value, or the particles
    (mcpid, generated_mass) of which the first with id 25 decides by its mass.
    """
    if isinstance(light, DataFrame):
        first = light.where("mcpid = 25").orderBy(*[c for c in ("event_id", "idx") if c in light.columns]).select("generated_mass").first()
        light = first is not None and first[0] < JET_CUTS["light_mass"]
    lead, other = (JET_CUTS["light_lead"], JET_CUTS["light_other"]) if light else (JET_CUTS["lead"], JET_CUTS["other"])
    if min_jetpt is not None:
        lead = other = min_jetpt
    tracks = JET_CUTS["tracks"] if min_ntracks is None else min_ntracks
    hardest = F.max("pt").over(Window.partitionBy("event_id"))
    return jets.withColumn("_lead", hardest).where((F.col("_lead") > lead) & (F.col("pt") > other) & (F.col("n_leaves") >= tracks)).drop("_lead")
