"""Flat clustering by heat wavelets on the particle graph, by Chebyshev approximation."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .many import MOST_CELLS, gathered
from .physics import Nodes, affinity, ca_distance2, laplacian

DEGREE = 50


def scales(low: float, high: float, n: int) -> np.ndarray:
    """``n`` decreasing scales from high to low, logarithmic between 10^2 and 10^1; one scale is the highest."""
    return np.array([float(high)]) if n == 1 else (high - low) / 90 * (np.logspace(2, 1, n) - 10) + low


def coefficients(func, degree: int, grid: int | None = None, interval: tuple[float, float] = (-1.0, 1.0)) -> np.ndarray:
    """Chebyshev coefficients of a function on an interval; the constant one is halved."""
    grid = grid or degree + 1
    half, middle = (interval[1] - interval[0]) / 2, (interval[1] + interval[0]) / 2
    angle = np.pi * (np.arange(1, grid + 1) - 0.5) / grid
    out = 2 / grid * np.cos(np.arange(degree + 1)[:, None] * angle) @ func(half * np.cos(angle) + middle)
    out[0] /= 2
    return out


def checked(c) -> np.ndarray:
    """Coefficients as rows: a number, a list or a list of equally long lists."""
    if np.ndim(c) == 0 and not isinstance(c, (list, tuple)):
        return np.array([[c]], float)
    c = list(c)
    if not c:
        raise ValueError("Coefficients are an empty list.")
    if not np.iterable(c[0]):
        return np.array([c], float)
    if len({len(x) for x in c}) > 1:
        raise ValueError("All coefficient lists must be the same length.")
    return np.vstack([np.asarray(x, float) for x in c])


def filtered(signal: np.ndarray, matrix: np.ndarray, c, interval: tuple[float, float]) -> np.ndarray:
    """Sum of Chebyshev polynomials of the matrix times the signal, one row for each row of coefficients.

    The constant term counts half. A zero matrix gives zeros.
    """
    c = checked(c)
    if not np.any(matrix):
        return np.zeros((len(c), len(signal)))
    half, middle = (interval[1] - interval[0]) / 2, (interval[1] + interval[0]) / 2
    shifted = (matrix - middle * np.eye(len(matrix))) / half
    before, now = signal, shifted @ signal
    out = 0.5 * c[:, :1] * before
    for k in range(1, c.shape[1]):
        out = out + c[:, k : k + 1] * now
        before, now = now, 2 * shifted @ now - before
    return out


@lru_cache(maxsize=8)
def heat(degree: int, high: float) -> np.ndarray:
    """Coefficients of exp(-x) on [0, high]."""
    return coefficients(lambda x: np.exp(-x), degree, degree + 1, (0.0, high))


def wavelet(matrix: np.ndarray, seed: int, high: float = 2.0, degree: int = DEGREE) -> np.ndarray:
    """The heat wavelet at a particle."""
    return filtered(np.eye(len(matrix))[seed], matrix, heat(degree, high), (0.0, high))[0]


def wavelets(matrix: np.ndarray, chosen: np.ndarray, high: float = 2.0, degree: int = DEGREE) -> np.ndarray:
    """The heat wavelets at several particles, a column each, in one recurrence over all of them."""
    out = np.zeros((len(matrix), len(chosen)))
    if not np.any(matrix):
        return out
    c, half = heat(degree, high), high / 2
    shifted = (matrix - half * np.eye(len(matrix))) / half
    before = np.zeros_like(out)
    before[chosen, np.arange(len(chosen))] = 1.0
    now = shifted[:, chosen]
    out = 0.5 * c[0] * before
    for weight in c[1:]:
        out += weight * now
        before, now = now, 2 * (shifted @ now) - before
    return out


def scaled(values: np.ndarray) -> np.ndarray:
    """To [-1, 1]; NaN where all are equal."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (values - values.min()) / (values.max() - values.min()) - 1


def max_eigenvalue(matrix: np.ndarray) -> float:
    """Eigenvalue of the largest magnitude of a symmetric matrix."""
    values = np.linalg.eigvalsh(matrix)
    return float(values[np.abs(values).argmax()])


def graph(y: np.ndarray, phi: np.ndarray, sigma: float, normalised: bool = True) -> np.ndarray:
    affine = affinity(ca_distance2(y[:, None], phi[:, None], y[None, :], phi[None, :]), sigma, 2.0)
    np.fill_diagonal(affine, 0.0)
    out = laplacian(affine, affine.sum(0) if normalised else None)
    return np.where(np.abs(out) >= np.finfo(float).max, 0.0, out)


def seeds(y: np.ndarray, phi: np.ndarray, pt: np.ndarray) -> np.ndarray:
    """Particles by the sum of their distances times min(1/pt), ties by index."""
    with np.errstate(divide="ignore"):
        weight = np.sqrt(ca_distance2(y[:, None], phi[:, None], y[None, :], phi[None, :])) * np.minimum(1 / pt[:, None], 1 / pt[None, :])
    return np.argsort(weight.sum(0), kind="stable")


def groups(y: np.ndarray, phi: np.ndarray, pt: np.ndarray, sigma: float, cutoff: float, rounds: int, normalised: bool = True, degree: int = DEGREE) -> list[np.ndarray]:
    """Free particles below the cutoff, for each seed in turn; every free seed counts as a round, and may give an empty group."""
    matrix, free, out = graph(y, phi, sigma, normalised), np.ones(len(y), bool), []
    order, at = seeds(y, phi, pt), 0
    while len(out) < rounds and at < len(order):
        # the next free seeds, no more than there can be rounds yet; some may be taken before their turn
        chosen = order[at:][free[order[at:]]][: rounds - len(out)]
        if not len(chosen):
            break
        at = int(np.flatnonzero(order == chosen[-1])[0]) + 1
        for seed, values in zip(chosen, wavelets(matrix, chosen, degree=degree).T, strict=True):
            if free[seed]:
                found = np.flatnonzero(free & (scaled(values) < cutoff))
                free[found] = False
                out.append(found)
    return out


def cluster_particles(y, phi, pt, sigma: float = 0.11, cutoff: float = 0.0, rounds: int = 15, degree: int = DEGREE, normalised: bool = True) -> tuple[np.ndarray, list[list[int]]]:
    """Cluster of each particle, 0 for none, and the members of each; clusters may be empty."""
    found = groups(np.asarray(y, float), np.asarray(phi, float), np.asarray(pt, float), sigma, cutoff, rounds, normalised, degree) if len(y) else []
    label = np.zeros(len(y), np.int64)
    for k, members in enumerate(found):
        label[members] = k + 1
    return label, [m.tolist() for m in found]


def cluster(nodes: Nodes, Sigma: float = 0.1, Cutoff: float = 0.0, NRounds: int = 15, Normalised: bool = True) -> Nodes:
    """Groups of :func:`groups` as jets, particles in none as jets of their own."""
    n = nodes.n
    if not n:
        return nodes
    y, phi, pt = nodes.y[:n].copy(), nodes.phi[:n].copy(), nodes.pt[:n].copy()
    found = [g for g in groups(y, phi, pt, Sigma, Cutoff, min(NRounds, n), Normalised) if len(g)]
    taken = np.concatenate(found) if found else np.zeros(0, np.int64)
    for members in [*found, *([i] for i in np.setdiff1d(np.arange(n), taken))]:
        nodes.gather(members)
    return nodes


def _graphs(y: np.ndarray, phi: np.ndarray, pt: np.ndarray, sigma: float, normalised: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """:func:`graph` and :func:`seeds` of events with as many particles, an event a row."""
    distance2, diagonal = ca_distance2(y[:, :, None], phi[:, :, None], y[:, None, :], phi[:, None, :]), np.arange(y.shape[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        order = np.argsort((np.sqrt(distance2) * np.minimum(1 / pt[:, :, None], 1 / pt[:, None, :])).sum(1), axis=1, kind="stable")
        affine = affinity(distance2, sigma, 2.0)
        affine[:, diagonal, diagonal] = 0.0
        degrees, matrix = affine.sum(1), -affine
        matrix[:, diagonal, diagonal] += degrees
        if normalised:
            scale = 1 / np.sqrt(degrees)
            matrix = np.nan_to_num(scale[:, :, None] * matrix * scale[:, None, :])
    matrix[np.abs(matrix) >= np.finfo(float).max] = 0.0
    return matrix, order


def many(events: list[np.ndarray], Sigma: float = 0.1, Cutoff: float = 0.0, NRounds: int = 15, Normalised: bool = True) -> list[tuple | None]:
    """The tables of :func:`cluster` for many small events, those with as many particles together. All particles' wavelets
    are made at once, so None for events of more than twice the rounds, which need few of them, and for numbers that aren't finite."""
    out: list[tuple | None] = [None] * len(events)
    sizes = np.array([len(e) if len(e) <= 2 * NRounds and np.isfinite(e).all() else 0 for e in events])
    for n in np.unique(sizes[sizes > 0]).tolist():
        every = np.flatnonzero(sizes == n)
        for at in np.array_split(every, -(-len(every) * n**2 // MOST_CELLS)):
            some = [events[k] for k in at]
            pt, y, phi = np.stack(some)[:, :, 4:].transpose(2, 0, 1)
            matrix, order = _graphs(y, phi, pt, Sigma, Normalised)
            for k, found in zip(at, gathered(some, _grouped(matrix, order, Cutoff, min(NRounds, n)).ravel()), strict=True):
                out[k] = found
    return out


def _grouped(matrix: np.ndarray, order: np.ndarray, cutoff: float, rounds: int, high: float = 2.0, degree: int = DEGREE) -> np.ndarray:
    """The group of each particle, an event a row: those of :func:`groups` without the empty ones, then particles in none, each its own."""
    count, n, _ = matrix.shape
    zero, half, diagonal = ~matrix.any((1, 2)), high / 2, np.arange(n)
    c = heat(degree, high)
    shifted = matrix.copy()
    shifted[:, diagonal, diagonal] -= half
    shifted /= half
    before, now = np.broadcast_to(np.eye(n), shifted.shape), shifted
    values = 0.5 * c[0] * before
    for weight in c[1:]:
        values += weight * now
        before, now = now, 2 * (shifted @ now) - before
    values[zero] = 0.0
    low = values.min(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        below = 2 * (values - low) / (values.max(1, keepdims=True) - low) - 1 < cutoff
    every, free, group = np.arange(count), np.ones((count, n), bool), np.full((count, n), -1, np.int64)
    made, used = np.zeros(count, np.int64), np.zeros(count, np.int64)
    for seed in order.T:
        turn = free[every, seed] & (used < rounds)
        found = free & below[every, :, seed] & turn[:, None]
        group = np.where(found, made[:, None], group)
        free &= ~found
        made += found.any(1)
        used += turn
    return np.where(free, made[:, None] + np.cumsum(free, axis=1) - 1, group)


def first_scaled(events: list[np.ndarray], sigma: float = 0.1, high: float = 2.0, degree: int = DEGREE) -> list[np.ndarray]:
    """The scaled wavelet at each event's first seed (events are rows of rapidity, phi, pt); events with as many particles go together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(events)
    sizes = np.array([len(e) for e in events])
    c, half = heat(degree, high), high / 2
    for n in np.unique(sizes):
        every = np.flatnonzero(sizes == n)
        for at in np.array_split(every, -(-len(every) * int(n) ** 2 // MOST_CELLS)):
            y, phi, pt = np.stack([events[k] for k in at]).transpose(2, 0, 1)
            matrix, order = _graphs(y, phi, pt, sigma)
            seed, diagonal, zero = order[:, 0], np.arange(n), ~matrix.any((1, 2))
            matrix[:, diagonal, diagonal] -= half
            shifted = matrix / half
            before = np.zeros((len(at), int(n), 1))
            before[np.arange(len(at)), seed] = 1.0
            now = shifted @ before
            total = 0.5 * c[0] * before
            for weight in c[1:]:
                total += weight * now
                before, now = now, 2 * (shifted @ now) - before
            total[zero] = 0.0
            for k, values in zip(at, total[:, :, 0], strict=True):
                out[k] = values
    return [scaled(v) for v in out]
