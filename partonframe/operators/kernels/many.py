"""Many small events at once: node tables that grow by merges, an event a row of every array.

A step of one event of 40 particles costs numpy more in calls than in arithmetic, so the kernels take the same step of
some hundred events together. Events are padded to the largest of them, which is of about the same size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from .physics import TURN, rapidity

#: Particles up to which an event is batched with others, and numbers in a matrix of all pairs of a batch's events.
MOST_SMALL, MOST_CELLS = 128, 400_000


def batches(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of events, those of like size together, as many as keep their matrices small."""
    order = np.argsort(sizes, kind="stable")[::-1]
    at = 0
    while at < len(order):
        count = max(1, min(MOST_CELLS // max(int(sizes[order[at]]) ** 2, 1), 4096))
        yield order[at : at + count]
        at += count


def each_batch(events: list[np.ndarray], run: Callable[[Many], np.ndarray]) -> list[tuple | None]:
    """(root, integers, floats, lifetimes) of each event (rows of px, py, pz, energy, pt, rapidity, phi), None for those that
    ``run`` returns as odd: the places in its batch that need the kernel of one event."""
    out: list[tuple | None] = [None] * len(events)
    sizes = np.array([len(e) for e in events])
    for places in batches(sizes):
        made = Many([events[p] for p in places])
        odd = set(run(made).tolist())
        for k, found in enumerate(made.tables()):
            out[places[k]] = None if k in odd else found
    return out


def gathered(events: list[np.ndarray], group: np.ndarray) -> list[tuple]:
    """The tables of :func:`physics.Nodes.gather` for many events (rows as in :func:`each_batch`). ``group`` has for the particles
    of all events the number of their group in their event, counted from 0 in order of creation, -1 for none."""
    n = np.array([len(e) for e in events])
    ends = np.cumsum(n)
    made = np.maximum.reduceat(group, ends - n) + 1
    each, tops = n + made, np.cumsum(n + made)
    event = np.repeat(np.arange(len(n)), n)
    leaf = np.arange(ends[-1]) - (ends - n)[event] + (tops - each)[event]
    ints, floats = np.full((tops[-1], 5), -1, np.int64), np.zeros((tops[-1], 9))
    ints[:, 0] = np.arange(tops[-1]) - np.repeat(tops - each, each)
    flat = np.concatenate(events)
    floats[leaf, :7], floats[leaf, 8] = flat[:, [4, 5, 6, 3, 0, 1, 2]], 1.0
    ints[leaf, 1] = np.where(group >= 0, n[event] + group, -1)
    inside, top = group >= 0, np.ones(tops[-1], bool)
    np.add.at(floats[:, 3:], (leaf + (ints[leaf, 1] - ints[leaf, 0]))[inside], floats[leaf[inside], 3:])
    top[leaf] = False
    energy, px, py, pz = floats[top, 3:7].T
    pt = np.hypot(px, py)
    with np.errstate(over="ignore", invalid="ignore"):
        floats[top, :3] = np.column_stack([pt, rapidity(pt, pz, energy), np.arctan2(py, px)])
        floats[:, 2] = np.mod(floats[:, 2] + np.pi, TURN) - np.pi
    floats[top, 7] = np.nan
    ints[top, 2] = ints[top, 3] = ints[top, 0]
    ints[top, 4] = 0
    root = np.where(ints[:, 1] >= 0, ints[:, 1], ints[:, 0])
    return [(root[a:b], ints[a:b], floats[a:b], np.zeros((b - a, 2), np.int64)) for a, b in zip((tops - each).tolist(), tops.tolist(), strict=True)]


class Many:
    """Node tables of several events, as :class:`physics.Nodes` has them for one; labels are rows."""

    def __init__(self, events: list[np.ndarray]):
        self.n = np.array([len(e) for e in events])
        self.wide = int(self.n.max())
        count, rows = len(events), max(2 * self.wide, 2)
        self.ints = np.full((count, rows, 5), -1, np.int64)
        self.ints[:, :, 0] = np.arange(rows)
        self.floats = np.full((count, rows, 9), np.nan)
        there = np.arange(self.wide) < self.n[:, None]
        flat = np.concatenate(events)
        for k, source in enumerate((4, 5, 6, 3, 0, 1, 2)):
            self.floats[:, : self.wide, k][there] = flat[:, source]
        self.floats[:, : self.wide, 7][there], self.floats[:, : self.wide, 8][there] = 0.0, 1.0
        self.there, self.used, self.step = there, self.n.copy(), np.zeros(count, np.int64)
        self.born, self.last = np.zeros((count, rows), np.int64), np.full((count, rows), -1, np.int64)

    def merge(self, e: np.ndarray, i: np.ndarray, j: np.ndarray, distance2: np.ndarray) -> np.ndarray:
        """A new node of rows i and j in each of the events e, which differ; their rows."""
        row = self.used[e]
        self.ints[e, row, 2], self.ints[e, row, 3] = i, j
        self.ints[e, row, 4] = np.maximum(self.ints[e, i, 4], self.ints[e, j, 4]) + 1
        energy, px, py, pz = (self.floats[e, i, 3:7] + self.floats[e, j, 3:7]).T
        pt = np.hypot(px, py)
        with np.errstate(over="ignore", invalid="ignore"):
            self.floats[e, row] = np.column_stack([pt, rapidity(pt, pz, energy), np.arctan2(py, px), energy, px, py, pz, np.sqrt(distance2), self.floats[e, i, 8] + self.floats[e, j, 8]])
        self.ints[e, i, 1] = self.ints[e, j, 1] = row
        self.used[e] += 1
        self.last[e, i] = self.last[e, j] = self.step[e]
        self.step[e] += 1
        self.born[e, row] = self.step[e]
        return row

    def retire(self, e: np.ndarray, i: np.ndarray) -> None:
        """Row i of each of the events e is a jet and takes no part in later steps."""
        self.last[e, i] = self.step[e]
        self.step[e] += 1

    def tables(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Label of each used node's root, its integers, its floats with phi in [-pi, pi), and its lifetime, for each event."""
        root = np.where(self.ints[:, :, 1] >= 0, self.ints[:, :, 1], self.ints[:, :, 0])
        while True:
            above = np.take_along_axis(root, root, 1)
            if np.array_equal(above, root):
                break
            root = above
        floats = self.floats
        with np.errstate(invalid="ignore"):
            floats[:, :, 2] = np.mod(floats[:, :, 2] + np.pi, TURN) - np.pi
        lives = np.stack([self.born, np.where(self.last < 0, self.step[:, None], self.last)], axis=2)
        for k, used in enumerate(self.used):
            yield root[k, :used], self.ints[k, :used], floats[k, :used], lives[k, :used]
