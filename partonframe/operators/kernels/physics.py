"""Numpy twins of the column expressions that clustering needs at every step."""

from __future__ import annotations

import numpy as np

TURN = 2 * np.pi


def angle_gap(a, b):
    """Exactly the same both ways round."""
    raw = np.abs(np.subtract(a, b))
    if not (raw <= TURN).all():  # a remainder is slow, and angles mostly are less than a turn apart
        raw = np.mod(raw, TURN)
    return np.minimum(raw, TURN - raw)


def ca_distance2(y1, phi1, y2, phi2):
    gap, dy = angle_gap(phi1, phi2), np.subtract(y1, y2)
    if gap.shape != dy.shape:
        return np.square(gap) + np.square(dy)
    # in place, since new memory for large arrays costs more than the arithmetic
    gap *= gap
    dy *= dy
    gap += dy
    return gap


def rapidity(pt, pz, energy):
    with np.errstate(divide="ignore", invalid="ignore"):
        rest2 = np.maximum(energy**2 - pz**2 - pt**2, 0)
        size = 0.5 * np.log((pt**2 + rest2) / (energy - np.abs(pz)) ** 2)
        value = np.where((pt == 0) & (energy == np.abs(pz)), np.inf, size)
    return np.where(pz == 0, 0.0, np.sign(pz) * value)[()]


def factor(form, exponent, one, two):
    """Factor of a pair by PT format: None, genkt, ratiokt or suppressedkt."""
    if form is None:
        return np.ones(np.broadcast(one, two).shape)
    if form == "suppressedkt":
        return suppression(exponent, np.minimum(one, two))
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = np.power(one, float(exponent)), np.power(two, float(exponent))
        return np.minimum(a, b) if form == "genkt" else np.minimum(a, b) / np.maximum(a, b)


def suppression(constant, value):
    return 1 - constant / (constant + value)


def affinity(distance2, sigma, exponent):
    return np.exp(-np.power(distance2, exponent / 2) / sigma)


def nearest(distance: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k + 1 least entries of each column, ties by row, and its transpose."""
    n = len(distance)
    rank = np.empty((n, n), np.int64)
    np.put_along_axis(rank, np.argsort(distance, axis=0, kind="stable"), np.arange(n)[:, None], axis=0)
    mask = rank <= k
    return mask | mask.T


def laplacian(affinities: np.ndarray, norm: np.ndarray | None) -> np.ndarray:
    """D - A, scaled by 1 / sqrt(norm) on either side; rows that can't be scaled are 0."""
    out = np.diag(affinities.sum(0)) - affinities
    if norm is None:
        return out
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = 1 / np.sqrt(norm)
        out = scale[:, None] * out * scale[None, :]
    return np.nan_to_num(out)


class Nodes:
    """Node table of an event that grows by merges. Inputs come first, in order of their index.

    ``born`` and ``last`` are the first and the last step before which a node is live; steps count from 0.
    """

    def __init__(self, px, py, pz, energy, pt, y, phi, labels=None):
        n = len(px)
        self.n, self.used = n, n
        rows = max(2 * n - 1, n)
        self.ints = np.full((rows, 5), -1, np.int64)
        self.floats = np.full((rows, 9), np.nan)
        self.ints[:n, 0] = np.arange(n) if labels is None else labels
        self.floats[:n] = np.column_stack([pt, y, phi, energy, px, py, pz, np.zeros(n), np.ones(n)])
        self.top = int(self.ints[:n, 0].max(initial=-1))
        self.step, self.born, self.last = 0, np.zeros(rows, np.int64), np.full(rows, -1, np.int64)

    pt = property(lambda self: self.floats[:, 0])
    y = property(lambda self: self.floats[:, 1])
    phi = property(lambda self: self.floats[:, 2])
    size = property(lambda self: self.floats[:, 8])

    def _label(self) -> int:
        self.top += 1
        return self.top

    def _momentum(self, row: int, members) -> None:
        total = self.floats[members, 3:7].sum(0)
        energy, px, py, pz = total
        pt = np.hypot(px, py)
        self.floats[row] = [pt, rapidity(pt, pz, energy), np.arctan2(py, px), energy, px, py, pz, np.nan, self.floats[members, 8].sum()]

    def merge(self, i: int, j: int, distance2: float) -> int:
        """A new node of rows i and j; its row."""
        row, label = self.used, self._label()
        self.ints[row] = [label, -1, self.ints[i, 0], self.ints[j, 0], max(self.ints[i, 4], self.ints[j, 4]) + 1]
        self._momentum(row, [i, j])
        self.floats[row, 7] = np.sqrt(distance2)
        self.ints[[i, j], 1] = label
        self.used += 1
        self._end([i, j])
        self.born[row] = self.step
        return row

    def retire(self, i: int) -> None:
        """Row i is a jet and takes no part in later steps."""
        self._end([i])

    def _end(self, rows: list[int]) -> None:
        self.last[rows] = self.step
        self.step += 1

    def lifetimes(self) -> np.ndarray:
        """First and last step before which each used node is live; those left at the end are so before the step that isn't taken."""
        last = self.last[: self.used]
        return np.column_stack([self.born[: self.used], np.where(last < 0, self.step, last)])

    def gather(self, members) -> int:
        """A root over rows that have none yet: its own child, of rank 0, without join distance."""
        if self.used == len(self.ints):
            self.ints = np.vstack([self.ints, np.full((self.n + 1, 5), -1, np.int64)])
            self.floats = np.vstack([self.floats, np.full((self.n + 1, 9), np.nan)])
            self.born, self.last = np.append(self.born, np.zeros(self.n + 1, np.int64)), np.append(self.last, np.full(self.n + 1, -1))
        row, label = self.used, self._label()
        self.ints[row] = [label, -1, label, label, 0]
        self._momentum(row, list(members))
        self.ints[list(members), 1] = label
        self.used += 1
        return row

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label of each used node's root, its integers and its floats, phi in [-pi, pi)."""
        ints, floats = self.ints[: self.used], self.floats[: self.used].copy()
        place = {int(label): i for i, label in enumerate(ints[:, 0])}
        root = ints[:, 0].copy()
        for i in range(len(ints) - 1, -1, -1):  # a parent is always made after its children
            if ints[i, 1] >= 0:
                root[i] = root[place[int(ints[i, 1])]]
        floats[:, 2] = np.mod(floats[:, 2] + np.pi, TURN) - np.pi
        return root, ints, floats
