"""The state of a clustering at any step, from the steps between which every node is live.

A node is live before a step if it was born by then and has neither been merged nor become a jet: an interval of
steps, closed on both sides. States are interval joins within an event, so no state is stored, and a history is one
row a node however many steps an event takes. Step 0 is the input; the state after an event's last step has the
number of its steps. Partitions (cones, wavelets, groups of one's own) have no steps: all their nodes live at 0.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LIFETIMES, NODES
from .cluster import cluster


def history(particles: DataFrame, algorithm: str, params: Mapping[str, object] | None = None, clustered: bool = False) -> DataFrame:
    """Nodes of all events that could be clustered, with ``born`` and ``last``, the first and last step before which each is live."""
    return cluster(particles, algorithm, params, clustered=clustered, lived=True).where("status = 'ok'").select(*NODES.fieldNames(), *LIFETIMES)


def within(step: Column) -> Column:
    """Whether a row's interval has the step."""
    return (F.col("born") <= step) & (F.col("last") >= step)


def at_step(nodes: DataFrame, step: int) -> DataFrame:
    """The nodes that are live before a step, the same in all events; events that take fewer steps have none."""
    return nodes.where(within(F.lit(step)))


def at_steps(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Live nodes of chosen states (event_id, step), the columns of both; each state once for each of its rows."""
    asked = steps.select("event_id", F.col("step").cast("long").alias("step"))
    return nodes.join(asked, "event_id").where(within(F.col("step")))


def by_step(rows: DataFrame, steps: Sequence[int], values: Mapping[str, tuple[Callable[[Column], Column], Column]]) -> DataFrame:
    """(event_id, step, n, and each value's aggregate) over the rows that are live before some steps, the same in all events;
    states without rows are left out. ``values`` has an aggregate and what it is of. A row is read once, whatever the steps."""
    now = {int(s): within(F.lit(int(s))) for s in steps}
    state = lambda s, on: F.struct(F.lit(s).cast("long").alias("step"), F.count_if(on).alias("n"), *[f(F.when(on, x)).alias(k) for k, (f, x) in values.items()])
    each = rows.groupBy("event_id").agg(F.array(*[state(s, on) for s, on in now.items()]).alias("x"))
    return each.select("event_id", F.explode("x").alias("x")).select("event_id", "x.*").where("n > 0")


def ever(nodes: DataFrame, steps: Sequence[int]) -> DataFrame:
    """The nodes that are live before one of some steps at least; no others are in the states of these steps."""
    return nodes.where(reduce(or_, [within(F.lit(int(s))) for s in steps]))


def available(nodes: DataFrame) -> DataFrame:
    """Nodes that are left at the end: no step has merged them or made them a jet."""
    return nodes.withColumn("_end", F.max("last").over(Window.partitionBy("event_id"))).where(F.col("last") == F.col("_end")).drop("_end")


def live_pairs(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(event_id, i, j, born, last, x_i and x_j of each column): pairs of nodes i < j that are ever live at once, with the steps at which they are.

    This is the index of a matrix over all states: :func:`at_step` and :func:`at_steps` of it are the minor of one.
    """
    side = lambda k: nodes.select("event_id", F.col("label").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in (*LIFETIMES, *columns)])
    met = side("i").join(side("j"), "event_id").where((F.col("i") < F.col("j")) & (F.col("born_i") <= F.col("last_j")) & (F.col("born_j") <= F.col("last_i")))
    both = {"born": F.greatest("born_i", "born_j"), "last": F.least("last_i", "last_j")}
    return met.select("event_id", "i", "j", *[c.alias(k) for k, c in both.items()], *[f"{c}_{k}" for c in columns for k in ("i", "j")])


def minor(matrix: DataFrame, live: DataFrame) -> DataFrame:
    """Entries of a ``matrix`` (event_id, i, j, value) over labels whose row and column are both ``live`` (event_id, label)."""
    for k in ("i", "j"):
        matrix = matrix.join(live.select("event_id", F.col("label").alias(k)), ["event_id", k], "left_semi")
    return matrix.select("event_id", "i", "j", "value")


def running(nodes: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    """(event_id, step, and the sum of each whole-number column over the live nodes) for every state of every event.

    Births add and ends subtract; a running sum over an event's 2n changes gives all states without listing any.
    """
    # both changes come from one row: with a union Spark would cluster the events twice
    change = lambda step, sign: F.struct(step.alias("step"), *[(F.lit(sign) * c).cast("long").alias(k) for k, c in sums.items()])
    changes = nodes.select("event_id", F.explode(F.array(change(F.col("born"), 1), change(F.col("last") + 1, -1))).alias("x")).select("event_id", "x.*")
    # one shuffle serves the aggregate and the windows
    each = changes.repartition("event_id").groupBy("event_id", "step").agg(*[F.sum(k).alias(k) for k in sums])
    so_far = Window.partitionBy("event_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    states = each.select("event_id", "step", *[F.sum(k).over(so_far).alias(k) for k in sums], F.lead("step").over(Window.partitionBy("event_id").orderBy("step")).alias("_next"))
    return states.where("_next is not null").drop("_next")
