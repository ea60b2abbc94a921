"""Iterative cones around the hardest particles."""

from __future__ import annotations

import numpy as np

from .many import batches, gathered
from .physics import Nodes, ca_distance2, factor, rapidity

STABLE, MOST_TURNS = 0.01, 100
#: Transverse momenta that agree within this part of them are a tie: their last bits depend on how they were computed.
TIE = 1e-9


def cluster(nodes: Nodes, DeltaR: float = 0.8, SeedThreshold: float = 1.0, ExpofPTInput: float = 0.0, ExpofPTFormatInput: str | None = None, PhyDistance: str = "angular") -> Nodes:
    """The hardest free particle above the threshold seeds a cone, of equal ones the first; the axis moves to the sum of
    the cone's content until its energy is stable or the content repeats; the content is a jet. What is left has no parent."""
    n = nodes.n
    free = np.ones(n, bool)
    while free.any():
        pt = np.where(free, nodes.pt[:n], -np.inf)
        hardest = pt.max()
        seed = int(np.flatnonzero(pt >= hardest - TIE * abs(hardest))[0])
        if not pt[seed] > SeedThreshold:
            break
        y, phi, hard, energy = nodes.y[seed], nodes.phi[seed], nodes.pt[seed], nodes.floats[seed, 3]
        seen, members = set(), np.array([seed])
        for _ in range(MOST_TURNS):
            f = factor(ExpofPTFormatInput, ExpofPTInput, hard, nodes.pt[:n])
            inside = np.flatnonzero(free & (ca_distance2(y, phi, nodes.y[:n], nodes.phi[:n]) * f * f < DeltaR**2))
            if not len(inside) or tuple(inside) in seen:
                break
            seen.add(tuple(inside))
            members = inside
            total = nodes.floats[inside, 3:7].sum(0)
            shift = abs(total[0] - energy) / abs(total[0]) if total[0] else 0.0
            energy, hard, phi = total[0], np.hypot(total[1], total[2]), np.arctan2(total[2], total[1])
            y = rapidity(hard, total[3], energy)
            if shift <= STABLE:
                break
        nodes.gather(members)
        free[members] = False
    return nodes


def many(events: list[np.ndarray], DeltaR: float = 0.8, SeedThreshold: float = 1.0, ExpofPTInput: float = 0.0, ExpofPTFormatInput: str | None = None, PhyDistance: str = "angular") -> list[tuple | None]:
    """The tables of :func:`cluster` for many small events, turn by turn of all; None for those with numbers that aren't finite."""
    out: list[tuple | None] = [None] * len(events)
    fine = np.array([k for k, e in enumerate(events) if np.isfinite(e).all()], np.int64)
    for places in batches(np.array([len(events[k]) for k in fine])):
        some = [events[k] for k in fine[places]]
        for k, found in zip(fine[places], gathered(some, _together(some, DeltaR**2, SeedThreshold, ExpofPTInput, ExpofPTFormatInput)), strict=True):
            out[k] = found
    return out


def _together(events: list[np.ndarray], within: float, threshold: float, exponent: float, form: str | None) -> np.ndarray:
    """The number of each particle's cone in its event, -1 for none, event after event."""
    n = np.array([len(e) for e in events])
    free = np.arange(n.max()) < n[:, None]
    there, group, made = free.copy(), np.full(free.shape, -1, np.int64), np.zeros(len(n), np.int64)
    whole = np.zeros((*free.shape, 7))
    whole[free] = np.concatenate(events)
    momenta, (pts, ys, phis) = whole[:, :, [3, 0, 1, 2]], whole[:, :, 4:].transpose(2, 0, 1)
    y, phi, hard, energy = np.zeros((4, len(n)))
    members, turn, fresh, on = np.zeros_like(free), np.zeros(len(n), np.int64), np.ones(len(n), bool), np.arange(len(n))
    seen = np.zeros((len(n), MOST_TURNS, -(-free.shape[1] // 8)), np.uint8)
    while True:
        new = on[fresh[on]]
        if len(new):
            pt = np.where(free[new], pts[new], -np.inf)
            hardest = pt.max(1)
            seed = (pt >= (hardest - TIE * np.abs(hardest))[:, None]).argmax(1)
            over = free[new].any(1) & (pt[np.arange(len(new)), seed] > threshold)
            fresh[new[~over]] = False
            on = on[np.isin(on, new[~over], invert=True)]
            new, seed = new[over], seed[over]
            y[new], phi[new], hard[new], energy[new] = ys[new, seed], phis[new, seed], pts[new, seed], momenta[new, seed, 0]
            members[new], turn[new], fresh[new] = False, 0, False
            members[new, seed] = True
        if not len(on):
            return group[there]
        near = ca_distance2(y[on, None], phi[on, None], ys[on], phis[on])
        if form is not None:
            f = factor(form, exponent, hard[on, None], pts[on])
            near = near * f * f
        inside = free[on] & (near < within)
        bits, before = np.packbits(inside, axis=1), np.arange(turn[on].max(initial=0))
        stop = ~inside.any(1) | ((seen[on, : len(before)] == bits[:, None]).all(2) & (before < turn[on, None])).any(1)
        go = on[~stop]
        inside = inside[~stop]
        seen[go, turn[go]] = bits[~stop]
        members[go] = inside
        total = np.where(inside[:, :, None], momenta[go], 0.0).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            shift = np.where(total[:, 0] != 0, np.abs(total[:, 0] - energy[go]) / np.abs(total[:, 0]), 0.0)
        energy[go], hard[go], phi[go] = total[:, 0], np.hypot(total[:, 1], total[:, 2]), np.arctan2(total[:, 2], total[:, 1])
        y[go] = rapidity(hard[go], total[:, 3], energy[go])
        turn[go] += 1
        stop[~stop] = (shift <= STABLE) | (turn[go] >= MOST_TURNS)
        ends = on[stop]
        group[ends] = np.where(members[ends], made[ends, None], group[ends])
        made[ends] += 1
        free[ends] &= ~members[ends]
        fresh[ends] = True
