"""K-means with a distance of one's own for the assignment."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def euclidean(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.linalg.norm(points[:, None, :] - centres[None, :, :], axis=2)


def fit(points: np.ndarray, k: int, distance: Callable = euclidean, max_iter: int = 500, max_restarts: int = 500, patience: int = 5, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Labels, centres and score (sum of distances) of the best attempt; attempts end when the best score has come ``patience`` times."""
    points = np.asarray(points, float)
    if not 1 <= k <= len(points):
        raise ValueError(f"can't make {k} clusters of {len(points)} points")
    rng, best, again = np.random.default_rng(seed), None, 0
    for _ in range(max_restarts):
        found = _attempt(points, points[rng.choice(len(points), k, replace=False)], distance, max_iter)
        if best is None or found[2] < best[2] and not np.isclose(found[2], best[2]):
            best, again = found, 1
        elif np.isclose(found[2], best[2]):
            again += 1
        if again >= patience:
            break
    return best


def _attempt(points, centres, distance, max_iter):
    labels = None
    for _ in range(max_iter):
        gaps = distance(points, centres)
        now = np.where(np.isnan(gaps).all(1), 0, np.nan_to_num(gaps, nan=np.inf).argmin(1))
        if labels is not None and np.array_equal(now, labels):
            break
        labels = now
        for c in range(len(centres)):
            if (labels == c).any():
                mean = np.nanmean(points[labels == c], axis=0)
                if np.any(mean):
                    centres[c] = mean
    return labels, centres, float(np.nansum(distance(points, centres)[np.arange(len(points)), labels]))


#: Numbers in a matrix of the distances of a batch's points.
MOST_CELLS = 400_000


def many(groups: list[np.ndarray], k: int, distance: Callable = euclidean, max_iter: int = 500, max_restarts: int = 500, patience: int = 5, seed: int = 0) -> list[np.ndarray]:
    """The labels of :func:`fit` for each group of points, with at most as many clusters as points; groups take each attempt and step together.

    A distance of one's own sees the points of one group at a time.
    """
    how = {"max_iter": max_iter, "max_restarts": max_restarts, "patience": patience, "seed": seed}
    if distance is not euclidean:
        return [fit(g, min(k, len(g)), distance, **how)[0] for g in groups]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(groups)
    sizes = np.array([len(g) for g in groups])
    # groups of fewer points than k have other numbers of clusters
    for clusters in np.unique(np.minimum(sizes, k)):
        every = np.flatnonzero(np.minimum(sizes, k) == clusters)
        every, at = every[np.argsort(sizes[every], kind="stable")[::-1]], 0
        while at < len(every):
            some = every[at : at + max(1, MOST_CELLS // int(sizes[every[at]] * clusters))]
            for p, labels in zip(some, _fit_together([groups[p] for p in some], int(clusters), **how), strict=True):
                out[p] = labels[: sizes[p]]
            at += len(some)
    return out


def _fit_together(groups: list[np.ndarray], k: int, max_iter: int, max_restarts: int, patience: int, seed: int) -> np.ndarray:
    """Groups are padded to the largest. Those of one size draw the same places, since each would begin with the same seed; those whose best has come often enough leave."""
    n = np.array([len(g) for g in groups])
    there = np.arange(n.max()) < n[:, None]
    points = np.full((groups[0].shape[1], *there.shape), np.nan)
    points[:, there] = np.concatenate(groups).T
    sizes, size = np.unique(n, return_inverse=True)
    draws = [np.random.default_rng(seed) for _ in sizes]
    best, score, again = np.zeros(there.shape, np.int64), np.full(len(n), np.nan), np.zeros(len(n), np.int64)
    for turn in range(max_restarts):
        on = np.flatnonzero(again < patience)
        if not len(on):
            break
        chosen = np.stack([rng.choice(m, k, replace=False) for m, rng in zip(sizes, draws, strict=True)])[size[on]]
        labels, found = _attempt_together(points[:, on], there[on], points[:, on[:, None], chosen], max_iter)
        same = np.isclose(found, score[on])
        better = np.ones(len(on), bool) if turn == 0 else (found < score[on]) & ~same
        best[on[better]], score[on[better]], again[on[better]] = labels[better], found[better], 1
        again[on[same & ~better]] += 1
    return best


def _gaps(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of points to centres (axis, group, place), for each centre."""
    return np.stack([np.sqrt(sum((p - c[:, at, None]) ** 2 for p, c in zip(points, centres, strict=True))) for at in range(centres.shape[2])])


def _attempt_together(points: np.ndarray, there: np.ndarray, centres: np.ndarray, max_iter: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels and score of each group's attempt, as :func:`_attempt` gives them for one."""
    labels, k = np.full(there.shape, -1, np.int64), centres.shape[2]
    on = np.arange(len(there))
    some, real, moving = points, there, centres
    for _ in range(max_iter):
        gaps = _gaps(some, moving)
        now = np.where(np.isnan(gaps), np.inf, gaps).argmin(0)
        moved = ((now != labels[on]) & real).any(1)
        centres[:, on] = moving
        if not moved.any():
            break
        if not moved.all():
            on, now, some, real, moving = on[moved], now[moved], some[:, moved], real[moved], moving[:, moved]
        labels[on] = now
        place = (now + k * np.arange(len(on))[:, None]).ravel()
        add = lambda x: np.bincount(place, x.ravel(), k * len(on)).reshape(len(on), k)  # noqa: E731, B023
        known = ~np.isnan(some)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.stack([add(np.where(t, x, 0.0)) / add(t) for x, t in zip(some, known, strict=True)])
        # as nanmean: NaN where no member has the axis; an empty cluster stays, and so does one whose mean is zero
        moving = np.where((add(real) > 0) & (mean != 0).any(0), mean, moving)
    centres[:, on] = moving
    return labels, np.nansum(np.take_along_axis(_gaps(points, centres), labels[None], 0)[0], axis=1)
