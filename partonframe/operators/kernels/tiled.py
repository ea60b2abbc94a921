"""Nearest neighbours on the plane of rapidity and azimuth, kept in grids of cells while nodes merge."""

from __future__ import annotations

from collections import defaultdict
from heapq import heappop, heappush
from itertools import chain, product

import numpy as np

from .physics import TURN, Nodes, ca_distance2

#: Nodes of an occupied cell on average, at most, in the finest grid.
CROWD = 4
#: What a cell is wider than the distance searched for in it and its neighbours; far above a double's rounding, far below any distance that matters.
SLACK = 1e-6


class Grid:
    """Cells of at least ``size`` in both directions; azimuth closes on itself."""

    def __init__(self, size: float):
        self.size, self.reach2 = size, (size * (1 - SLACK)) ** 2
        self.turns = max(1, int(TURN // size))
        self.cells: defaultdict[tuple[int, int], dict[int, None]] = defaultdict(dict)
        #: of the nodes in a cell, those that a new node this far away may come closer to than their nearest one
        self.open: defaultdict[tuple[int, int], dict[int, None]] = defaultdict(dict)

    def cell(self, y: float, phi: float) -> tuple[int, int]:
        return int(y // self.size), int(phi % TURN / TURN * self.turns) % self.turns

    def around(self, cell: tuple[int, int], what: dict) -> list[int]:
        """What is in a cell and its neighbours."""
        a, b = cell
        beside = {(b - 1) % self.turns, b, (b + 1) % self.turns}
        return list(chain.from_iterable(what[c] for c in product((a - 1, a, a + 1), beside) if c in what))


def grids(y: np.ndarray, phi: np.ndarray, reach: float) -> list[Grid]:
    """From cells of few nodes to cells of at least ``reach``, each twice as wide as those before."""
    out = [Grid(reach * (1 + 3 * SLACK))]
    size = min(out[0].size, max(TURN / 2, np.ptp(y) if len(y) else 0.0))
    while len(out) < 24:
        turns = max(1, int(TURN // size))
        used = len(np.unique(np.column_stack([y // size, np.mod(phi, TURN) // (TURN / turns)]), axis=0))
        if len(y) <= CROWD * used:
            break
        size /= 2
        out.append(Grid(size))
    return out[::-1]


class Tiled:
    """The geometrically nearest node, or the beam, of every live node.

    A pair's factor is the less of its nodes' factors, so the least of all distances is that of some node, with its own
    factor, to the node nearest to it on the plane, or to the beam if none is within DeltaR: were another node nearer,
    its distance would be less. A node is nearest to a few others only, so a merge changes few rows; they are found
    in the cells around it. A node is searched for from the finest grid on, which ends at the first in
    which the nearest is within a cell's width. Memory grows with the number of nodes. A node of infinite rapidity is near
    to none and meets the beam only.
    """

    def __init__(self, nodes: Nodes, delta_r: float, exponent: float, form: str | None, tie: float):
        rows = len(nodes.ints)
        self.nodes, self.beam, self.exponent, self.form, self.tie = nodes, delta_r**2, float(exponent), form, tie
        self.y, self.phi, self.weight, self.near2 = (np.full(rows, np.inf) for _ in range(4))
        self.partner, self.made, self.level = [-1] * rows, [0] * rows, [0] * rows
        self.back: list[set[int]] = [set() for _ in range(rows)]
        on_plane = np.isfinite(nodes.y[: nodes.n])
        self.grids = grids(nodes.y[: nodes.n][on_plane], nodes.phi[: nodes.n][on_plane], delta_r)
        self.places: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
        self.heap: list[tuple[float, int, int]] = []
        for row in range(nodes.n):
            self._place(row)
        for row in range(nodes.n):
            self._search(row)

    def _place(self, row: int) -> None:
        """Puts a node into its cells; one of infinite rapidity is near to nothing and in none."""
        pt, y, phi = self.nodes.floats[row, :3].tolist()
        self.y[row], self.phi[row] = y, phi
        if self.form is None:
            self.weight[row] = 1.0
        else:
            with np.errstate(divide="ignore", over="ignore"):
                self.weight[row] = np.square(np.power(pt, self.exponent))
        if np.isfinite(y):
            self.places[row] = [g.cell(y, phi) for g in self.grids]
            for grid, cell in zip(self.grids, self.places[row], strict=True):
                grid.cells[cell][row] = None

    def _search(self, row: int) -> None:
        last = len(self.grids) - 1
        seen = 0
        for level, cell in enumerate(self.places[row]):
            grid = self.grids[level]
            found = grid.around(cell, grid.cells)
            if len(found) == seen and level < last:  # nothing new
                continue
            seen = len(found)
            others = np.array(found)
            d2 = ca_distance2(self.y[row], self.phi[row], self.y[others], self.phi[others])
            d2[others == row] = self.beam
            least = d2.min()
            if level == last or least * (1 + self.tie) <= grid.reach2:
                self._set(row, int(others[d2 <= least * (1 + self.tie)].min()), float(least), level)
                return
        self._set(row, row, self.beam, last)

    def _set(self, row: int, partner: int, near2: float, level: int) -> None:
        before = self.partner[row]
        if before >= 0:
            self.back[before].discard(row)
            self._close(row)
        self.partner[row], self.near2[row], self.level[row] = partner, near2, level
        if partner != row:
            self.back[partner].add(row)
        if self.places[row]:
            self.grids[level].open[self.places[row][level]][row] = None
        self.made[row] += 1
        distance = near2 * float(self.weight[row])
        entry = (distance if distance == distance else float("inf"), row, self.made[row])
        heappush(self.heap, entry)

    def _close(self, row: int) -> None:
        if self.places[row]:
            _take(self.grids[self.level[row]].open, self.places[row][self.level[row]], row)

    def _remove(self, row: int) -> set[int]:
        """Takes a node away; the nodes that it was nearest to."""
        self._close(row)
        for grid, cell in zip(self.grids, self.places[row], strict=False):
            _take(grid.cells, cell, row)
        self.back[self.partner[row]].discard(row)
        self.made[row] = -1
        lost, self.back[row], self.places[row] = self.back[row], set(), []
        return lost

    def closest(self) -> tuple[int, int, float]:
        heap, tied = self.heap, []
        while heap and (not tied or heap[0][0] <= tied[0][0] * (1 + self.tie)):
            entry = heappop(heap)
            if entry[2] == self.made[entry[1]]:
                tied.append(entry)
        i, j, distance = min((*sorted((row, self.partner[row])), distance) for distance, row, _ in tied)
        for entry in tied:
            heappush(heap, entry)
        return i, j, distance

    def replace(self, i: int, j: int, new: int | None) -> None:
        lost = (self._remove(i) | (self._remove(j) if i != j else set())) - {i, j}
        if new is not None:
            self._place(new)
            self._search(new)
            for row, d2, level in self._closer(new):
                if row not in lost:
                    self._set(row, new, d2, level)
        for row in lost:
            self._search(row)

    def _closer(self, new: int) -> list[tuple[int, float, int]]:
        """(row, squared distance, level) of the nodes that have nothing as near as ``new``."""
        rows = [row for g, cell in zip(self.grids, self.places[new], strict=False) for row in g.around(cell, g.open) if row != new]
        if not rows:
            return []
        others = np.array(rows)
        d2 = ca_distance2(self.y[new], self.phi[new], self.y[others], self.phi[others])
        found = np.flatnonzero(d2 < self.near2[others] * (1 - self.tie)).tolist()
        return [(rows[k], float(d2[k]), next(x for x, g in enumerate(self.grids) if d2[k] * (1 + self.tie) <= g.reach2 or g is self.grids[-1])) for k in found]


def _take(cells: dict, cell: tuple[int, int], row: int) -> None:
    """Removes a row, and a cell that holds no other."""
    rows = cells[cell]
    del rows[row]
    if not rows:
        del cells[cell]
