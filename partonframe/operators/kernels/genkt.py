"""Sequential recombination with the generalised kt distance: kt, Cambridge/Aachen, anti-kt and ratio variants."""

from __future__ import annotations

import numpy as np

from .many import Many, each_batch
from .physics import Nodes, ca_distance2, factor, suppression
from .tiled import Tiled

#: Particles up to which all distances are kept; with more, every node keeps its nearest one only, found on a grid where the factor allows it.
MOST_DENSE = 256
#: Distances that agree within this part of them are a tie: their last bits depend on how they were computed.
TIE = 1e-9
#: PT formats with the less of two nodes' own factors, or none: the closest pair is one of nearest neighbours on the plane.
PLANAR = {None, "genkt"}


def cluster(nodes: Nodes, DeltaR: float = 0.8, ExpofPTInput: float = 0.0, ExpofPTFormatInput: str | None = None, PhyDistance: str = "angular", steps: int | None = None) -> Nodes:
    """Merges the closest pair, or retires a node that is closer to the beam, until one node is left.

    Distances are dR^2 f^2 between nodes and DeltaR^2 f^2 to the beam; of those that agree with the least within TIE
    the first by (row, column) in order of creation wins. ``steps`` stops after so many.
    """
    n = nodes.n
    if n < 2:
        return nodes
    how = (nodes, DeltaR, ExpofPTInput, ExpofPTFormatInput)
    if n <= MOST_DENSE:
        pairs = Dense(*how)
    else:
        pairs = Tiled(*how, TIE) if DeltaR > 0 and ExpofPTFormatInput in PLANAR else Nearest(*how)
    left, done = n, 0
    while left > 1 and done != steps:
        i, j, distance2 = pairs.closest()
        if i == j:
            nodes.retire(i)
        pairs.replace(i, j, nodes.merge(i, j, distance2) if i != j else None)
        left -= 1
        done += 1
    return nodes


def many(events: list[np.ndarray], DeltaR: float = 0.8, ExpofPTInput: float = 0.0, ExpofPTFormatInput: str | None = None, PhyDistance: str = "angular") -> list[tuple | None]:
    """The tables of :func:`cluster` for many small events, step by step of all; None for those with distances that aren't finite."""
    return each_batch(events, lambda made: _together(made, DeltaR**2, ExpofPTInput, ExpofPTFormatInput))


def _own(form: str | None, exponent: float, pt: np.ndarray) -> np.ndarray:
    """What :func:`_paired` makes the factor of a pair from."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.power(pt, float(exponent)) if form in ("genkt", "ratiokt") else pt


def _paired(form: str | None, exponent: float, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        if form is None:
            return np.ones(np.broadcast(one, two).shape)
        least = np.minimum(one, two)
        return suppression(exponent, least) if form == "suppressedkt" else least if form == "genkt" else least / np.maximum(one, two)


def _together(made: Many, beam: float, exponent: float, form: str | None) -> np.ndarray:
    """Clusters all events of a batch; the places of those in which a distance isn't finite."""
    every, wide = np.arange(len(made.n)), made.wide
    event, left, alive = every, made.n.copy(), made.there.copy()
    row = np.broadcast_to(np.arange(wide), alive.shape).copy()
    pt, y, phi = (np.where(alive, made.floats[:, :wide, k], 1.0) for k in range(3))
    g, odd = _own(form, exponent, pt), np.zeros(len(every), bool)
    with np.errstate(over="ignore", invalid="ignore"):
        distance, diagonal = ca_distance2(y[:, :, None], phi[:, :, None], y[:, None, :], phi[:, None, :]), np.arange(wide)
        if form is not None:
            f = _paired(form, exponent, g[:, :, None], g[:, None, :])
            distance *= f
            distance *= f
        distance[:, diagonal, diagonal] = beam * _paired(form, exponent, g, g) ** 2
    both = alive[:, :, None] & alive[:, None, :]
    odd |= (both & ~np.isfinite(distance)).any((1, 2))
    distance[~both | odd[:, None, None]] = np.inf
    left[odd] = 1
    # the least of every row is kept, so that a step reads the rows that change and no matrix
    lowest, beyond = distance.min(1), made.ints.shape[1]
    while True:
        on = np.flatnonzero(left > 1)
        if not len(on):
            return np.flatnonzero(odd)
        if 4 * (most := int(left[on].max())) <= 3 * alive.shape[1] or 4 * len(on) <= 3 * len(left):  # events that are done and slots that nobody needs go
            slots = np.argsort(~alive[on], axis=1, kind="stable")[:, :most]
            event, left = event[on], left[on]
            distance = distance[on[:, None, None], slots[:, :, None], slots[:, None, :]]  # those of slots that are done stay in it
            alive, row, g, y, phi, lowest = (x[on[:, None], slots] for x in (alive, row, g, y, phi, lowest))
            on = np.arange(len(on))
        # both nodes of a tie have it as their least: the first of all such nodes is in the first tie, with the first of its partners
        e, limit = on, lowest[on].min(1) * (1 + TIE)
        a = np.where(lowest[e] <= limit[:, None], row[e], beyond).argmin(1)
        b = np.where((distance[e, a] <= limit[:, None]) & alive[e], row[e], beyond).argmin(1)
        least = distance[e, a, b]
        left[e] -= 1
        alone = a == b
        made.retire(event[e[alone]], row[e[alone], a[alone]])
        # of a pair the second slot goes, and the first has the new node; rows that had their least from either search again
        again = (distance[e, a] <= lowest[e]) | (distance[e, b] <= lowest[e])
        alive[e, b] = False
        lowest[e, b] = np.inf
        k, slot = np.nonzero(again & alive[e])
        ends = e[k]
        e, a, b, least = e[~alone], a[~alone], b[~alone], least[~alone]
        if not len(e):
            lowest[ends, slot] = np.where(alive[ends], distance[ends, slot], np.inf).min(1)
            continue
        at = event[e]
        new = made.merge(at, row[e, a], row[e, b], least)
        row[e, a] = new
        pt, y[e, a], phi[e, a] = made.floats[at, new, :3].T
        g[e, a] = own = _own(form, exponent, pt)
        with np.errstate(over="ignore", invalid="ignore"):
            f = _paired(form, exponent, own[:, None], g[e])
            near = ca_distance2(y[e, a][:, None], phi[e, a][:, None], y[e], phi[e]) * f * f
            f = _paired(form, exponent, own, own)
            near[np.arange(len(e)), a] = beam * f * f
        lost = (alive[e] & ~np.isfinite(near)).any(1)
        near = np.where(alive[e], near, np.inf)
        distance[e, a, :] = distance[e, :, a] = near
        lowest[e] = np.minimum(lowest[e], near)
        lowest[ends, slot] = np.where(alive[ends], distance[ends, slot], np.inf).min(1)
        lowest[e, a] = near.min(1)
        if lost.any():
            odd[at[lost]], left[e[lost]] = True, 1


class Dense:
    """All distances, a slot for every live node; a merged node takes the first slot of its parts."""

    def __init__(self, nodes: Nodes, delta_r: float, exponent: float, form: str | None):
        self.nodes, self.beam, self.exponent, self.form = nodes, delta_r**2, exponent, form
        self.row = np.arange(nodes.n)
        y, phi, pt = (x[: nodes.n] for x in (nodes.y, nodes.phi, nodes.pt))
        f = factor(form, exponent, pt[:, None], pt[None, :])
        self.distance = ca_distance2(y[:, None], phi[:, None], y[None, :], phi[None, :]) * f * f
        np.fill_diagonal(self.distance, self.beam * f.diagonal() ** 2)

    def closest(self) -> tuple[int, int, float]:
        i, j = divmod(int(self.distance.argmin()), len(self.row))
        ties = np.flatnonzero(self.distance <= self.distance[i, j] * (1 + TIE))
        if len(ties) > 1:
            i, j = min((divmod(t, len(self.row)) for t in ties.tolist()), key=lambda t: sorted(self.row[list(t)].tolist()))
        least = self.distance[i, j]
        i, j = sorted((int(self.row[i]), int(self.row[j])))
        return i, j, float(least)

    def replace(self, i: int, j: int, new: int | None) -> None:
        a, b = int(np.flatnonzero(self.row == i)[0]), int(np.flatnonzero(self.row == j)[0])
        keep = np.arange(len(self.row)) != (b if new is not None else a)
        self.row, self.distance = self.row[keep], self.distance[np.ix_(keep, keep)]
        if new is None:
            return
        a -= a > b
        self.row[a] = new
        self.distance[a] = self.distance[:, a] = _from(self.nodes, new, self.row, self.exponent, self.form)
        own = factor(self.form, self.exponent, self.nodes.pt[new], self.nodes.pt[new])
        self.distance[a, a] = self.beam * own * own


def _from(nodes: Nodes, row: int, others: np.ndarray, exponent: float, form: str | None) -> np.ndarray:
    f = factor(form, exponent, nodes.pt[row], nodes.pt[others])
    return ca_distance2(nodes.y[row], nodes.phi[row], nodes.y[others], nodes.phi[others]) * f * f


class Nearest:
    """The nearest node, or the beam, of every live node; memory grows with their number only."""

    def __init__(self, nodes: Nodes, delta_r: float, exponent: float, form: str | None):
        self.nodes, self.beam, self.exponent, self.form = nodes, delta_r**2, exponent, form
        self.row = np.arange(nodes.n)
        self.least, self.partner = np.empty(nodes.n), np.empty(nodes.n, np.int64)
        for slot in range(nodes.n):
            self._search(slot)

    def _distances(self, row: int) -> np.ndarray:
        out = _from(self.nodes, row, self.row, self.exponent, self.form)
        own = factor(self.form, self.exponent, self.nodes.pt[row], self.nodes.pt[row])
        out[self.row == row] = self.beam * own * own
        return out

    def _search(self, slot: int) -> None:
        distance = self._distances(int(self.row[slot]))
        self.least[slot] = distance.min()
        self.partner[slot] = self.row[distance <= self.least[slot] * (1 + TIE)].min()

    def closest(self) -> tuple[int, int, float]:
        at = np.flatnonzero(self.least <= self.least.min() * (1 + TIE))
        i, j, slot = min((*sorted((int(self.row[s]), int(self.partner[s]))), int(s)) for s in at)
        return i, j, float(self.least[slot])

    def replace(self, i: int, j: int, new: int | None) -> None:
        keep = (self.row != i) & (self.row != j)
        self.row, self.least, self.partner = self.row[keep], self.least[keep], self.partner[keep]
        lost = np.isin(self.partner, (i, j))
        if new is not None:
            self.row, self.least, self.partner, lost = np.append(self.row, new), np.append(self.least, np.inf), np.append(self.partner, new), np.append(lost, True)
            closer = self._distances(new) < self.least * (1 - TIE)
            closer[-1] = False
            if closer.any():
                self.least[closer], self.partner[closer] = self._distances(new)[closer], new
                lost &= ~closer
        for slot in np.flatnonzero(lost):
            self._search(int(slot))
