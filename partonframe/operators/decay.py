"""Walks along decay graphs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import whole_events

#: What a row of the walk is; a start without index or event has one or two more.
PARTICLE, EDGE, START, NO_INDEX, NO_EVENT = 0, 1, 2, 1, 2


def edge_instance(particles: DataFrame, edges: DataFrame, start: DataFrame, first: bool = True) -> DataFrame:
    """(event_id, start, idx): the ends of the chains of equal particle ids from each start.

    ``particles`` has event_id, idx and pid; ``edges`` event_id, parent and child; ``start`` event_id and idx.
    ``first`` follows parents, otherwise children. A particle without a further one of its id is an end; a
    cycle has none. The three tables meet in one shuffle by event, and a task walks many events at once: every round
    doubles the length of the jumps, so the rounds are the logarithm of the longest chain. No round writes or joins tables.
    """
    src, dst = ("child", "parent") if first else ("parent", "child")
    kind = START + F.isnull("idx").cast("int") * NO_INDEX + F.isnull("event_id").cast("int") * NO_EVENT
    tables = (
        (particles.where("event_id is not null and idx is not null"), walk_row(PARTICLE, "idx", pid="pid")),
        (edges.where(F.col("event_id").isNotNull() & F.col(src).isNotNull() & F.col(dst).isNotNull()), walk_row(EDGE, src, dst)),
        (start, walk_row(kind, "idx")),
    )
    nodes, steps, begins = (t.select(_number("event_id").alias("event_id"), r.alias("r")).select("event_id", "r.*") for t, r in tables)
    return ends(nodes.union(steps).union(begins))


def ends(rows: DataFrame, clustered: bool = False) -> DataFrame:
    """:func:`edge_instance` of one table with the :func:`walk_row` of all particles, edges (from and to) and starts as columns beside
    event_id; ``clustered`` is as in :func:`cluster.cluster`."""
    dealt = rows if clustered else rows.repartition("event_id")
    return dealt.sortWithinPartitions("event_id").mapInArrow(_walked, "event_id bigint, start bigint, idx bigint")


def walk_row(kind: Column | int, one: str, two: str | None = None, pid: str | None = None) -> Column:
    none = F.lit(None)
    kind = F.lit(kind) if isinstance(kind, int) else kind
    return F.struct(kind.cast("int").alias("kind"), _number(one).alias("one"), (_number(two) if two else none.cast("long")).alias("two"), (F.col(pid) if pid else none).alias("pid"))


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long"))


def _walked(batches: Iterator[pa.RecordBatch], rows_out: int = 50_000) -> Iterator[pa.RecordBatch]:
    return map(_ends, whole_events(batches, rows_out))


def _pairs(one: np.ndarray, two: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of numbers below n, in order."""
    return np.divmod(np.unique(one * n + two), n)


def _joined(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``asked`` and in the sorted ``keys`` of all pairs that are equal."""
    low, high = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
    counts = high - low
    return np.repeat(np.arange(len(asked)), counts), np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _ends(table: pa.Table) -> pa.RecordBatch:
    """The starts and ends of some events' chains."""
    event, kind, one = (table[c].to_numpy() for c in ("event_id", "kind", "one"))
    is_edge, is_start = kind == EDGE, kind == START
    two = table["two"].filter(pa.array(is_edge)).to_numpy()
    is_node = kind == PARTICLE
    pid = table["pid"].filter(pa.array(is_node)).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    # (event, index) as one number
    known, which = np.unique(np.r_[one, two], return_inverse=True)
    events, ordinal = np.unique(event, return_inverse=True)
    at, to = ordinal * len(known) + which[: len(one)], ordinal[is_edge] * len(known) + which[len(one) :]
    key, place = np.unique(np.r_[at, to], return_inverse=True)
    n = len(key)
    node, begin, a, b = place[: len(at)][is_node], place[: len(at)][is_start], place[: len(at)][is_edge], place[len(at) :]
    # edges between equal ids; null is equal to none
    there = pid >= 0
    ids = int(pid.max(initial=0)) + 1
    has = np.unique(node[there] * ids + pid[there])
    edge, found = _joined(has // ids, a)
    same = np.isin(b[edge] * ids + has[found] % ids, has)
    src, dst = _pairs(a[edge[same]], b[edge[same]], n)
    onward = np.zeros(n, bool)
    onward[src] = True
    ended = ~onward[dst]
    # no chain is longer than an event's edges; what hasn't ended by then is on or before a cycle
    longest = int(np.bincount(key[src] // len(known)).max(initial=0))
    for _ in range(longest.bit_length()):
        if ended.all():
            break
        left = np.flatnonzero(~ended)
        row, far = _joined(src, dst[left])
        further = (src[left][row], dst[far])
        src, dst = _pairs(np.r_[src[ended], further[0]], np.r_[dst[ended], further[1]], n)
        ended = ~onward[dst]
    begin = np.unique(begin)
    alone = begin[~onward[begin]]
    src, dst = src[ended], dst[ended]
    row, far = _joined(src, begin)
    starts, ends = np.r_[begin[row], alone], np.r_[dst[far], alone]
    # starts without index or event are ends of their own
    lost = np.unique(np.column_stack([event, one, kind])[kind > START], axis=0)
    columns = [np.r_[events[key[starts] // len(known)], lost[:, 0]], np.r_[known[key[starts] % len(known)], lost[:, 1]], np.r_[known[key[ends] % len(known)], lost[:, 1]]]
    missing = np.r_[np.zeros(len(starts), np.int64), lost[:, 2] - START]
    masks = [missing & NO_EVENT, missing & NO_INDEX, missing & NO_INDEX]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64(), mask=m > 0) for c, m in zip(columns, masks, strict=True)], ["event_id", "start", "idx"])


def edges_from_lists(events: DataFrame, children: str = "Children", parents: str | None = None) -> DataFrame:
    """(event_id, parent, child) of events with a list of children, or of parents, for each particle."""
    name = parents or children
    each = events.select("event_id", F.posexplode(name).alias("at", "others")).select("event_id", F.col("at").cast("long").alias("at"), F.explode("others").alias("other")).withColumn("other", F.col("other").cast("long"))
    return each.select("event_id", *([F.col("other").alias("parent"), F.col("at").alias("child")] if parents else [F.col("at").alias("parent"), F.col("other").alias("child")]))
