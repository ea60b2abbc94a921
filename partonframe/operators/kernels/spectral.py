"""Agglomeration in the eigenspace of a graph Laplacian of the particles."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

from .many import Many, each_batch
from .physics import Nodes, affinity, ca_distance2, factor, laplacian, nearest, suppression


class Local:
    """Suppressions and affinities between live nodes, kept up to date a row at a time."""

    def __init__(self, nodes: Nodes, p: dict):
        self.nodes, self.p = nodes, p
        rows = np.arange(nodes.n)
        self.single, self.affine = self._pair(rows[:, None], rows[None, :])
        self.affine *= self.single
        for m, value in ((self.affine, 0.0), (self.single, 1.0)):
            np.fill_diagonal(m, value)

    def _pair(self, i, j):
        nodes, p = self.nodes, self.p
        near2 = ca_distance2(nodes.y[i], nodes.phi[i], nodes.y[j], nodes.phi[j])
        f = factor(p["ExpofPTFormatInput"], p["ExpofPTInput"], nodes.pt[i], nodes.pt[j])
        g = factor(p["ExpofPTFormatAffinity"], p["ExpofPTAffinity"], nodes.pt[i], nodes.pt[j])
        c = p["SingularitySuppression"]
        single = np.ones(near2.shape) if c is None else suppression(c, np.minimum(nodes.pt[i], nodes.pt[j]) * np.sqrt(near2))
        return single, affinity(near2 * f * f, p["Sigma"], p["ExpofPhysDistance"]) * g * g

    def replace(self, live: np.ndarray, keep: np.ndarray, new: int) -> None:
        """Only ``keep`` of the live nodes go on, with ``new`` as the last; its affinities aren't suppressed."""
        grid = np.ix_(keep, keep)
        fresh = self._pair(np.full(len(keep), new), live[keep])
        self.single, self.affine = (_bordered(m[grid], *x) for m, *x in zip((self.single, self.affine), fresh, (1.0, 0.0), strict=True))

    def masked(self) -> np.ndarray:
        k = self.p["CutoffKNN"]
        return self.affine if k is None else np.where(nearest(-self.affine, k - 1), self.affine, 0.0)


def _bordered(matrix: np.ndarray, row: np.ndarray, corner: float) -> np.ndarray:
    """A symmetric matrix with one more row and column."""
    n = len(row)
    out = np.empty((n + 1, n + 1))
    out[:n, :n], out[n, :n], out[:n, n], out[n, n] = matrix, row, row, corner
    return out


def embedding_space(matrix: np.ndarray, num_dims: int | None = None, max_eigval: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) of a symmetric matrix, the first left out: the next ``num_dims``, or all up to ``max_eigval``."""
    if num_dims is None and max_eigval is None:
        raise ValueError("num_dims or max_eigval is needed")
    if not len(matrix):
        return np.zeros(0), np.zeros((0, 0))
    values, vectors = np.linalg.eigh(matrix)
    chosen = np.arange(len(values))[1 : num_dims + 1] if num_dims is not None else np.flatnonzero(values <= max_eigval)[1:]
    return values[chosen], vectors[:, chosen]


def dimension_scaling(values: np.ndarray, beta: float, clip: float) -> np.ndarray:
    return np.maximum(values, clip) ** -beta


def dimension_hardness(vectors: np.ndarray, pt: np.ndarray) -> np.ndarray:
    return (np.abs(vectors) * pt[:, None]).mean(0)


def graph_matrix(affine: np.ndarray, pt: np.ndarray, size: np.ndarray, kind: str) -> np.ndarray:
    return laplacian(affine, {"unnormed": None, "symmetric": affine.sum(0), "pt": pt, "symmetric_carried": size}[kind])


def embed(affine: np.ndarray, pt: np.ndarray, size: np.ndarray, p: dict) -> np.ndarray:
    """Coordinates by the eigenvectors up to the limit, but for the first; scaled by eigenvalue and hardness."""
    values, vectors = embedding_space(graph_matrix(affine, pt, size, p["Laplacian"]), max_eigval=p["EigenvalueLimit"])
    scale = dimension_scaling(values, p["Beta"], p["ClipBeta"]) if p["Beta"] else np.ones(len(values))
    if p["EmbedHardness"] == "pt":
        scale = scale * dimension_hardness(vectors, pt)
    return vectors * scale


def embedding_distance2(points: np.ndarray, kind: str) -> np.ndarray:
    if kind == "euclidiean":
        out = np.empty((len(points), len(points)))
        for row, point in zip(out, points, strict=True):  # all differences at once have the dimensions times as much
            row[:] = np.square(point - points).sum(-1)
    else:
        length = np.linalg.norm(points, axis=1)
        out = _angles(points @ points.T, length[:, None] * length[None, :], kind)
    np.fill_diagonal(out, np.inf)
    return out


def last_distance2(points: np.ndarray, kind: str) -> np.ndarray:
    """:func:`embedding_distance2` of the last point to the others, where a point is a column; of many events at once, too.

    Dimensions are added up in turn, so that further ones of zeros change no bit."""
    others, last = points[..., :-1], points[..., -1:]
    if kind == "euclidiean":
        return np.add.reduce(np.square(others - last), axis=-2)
    length = np.sqrt(np.add.reduce(np.square(points), axis=-2))
    return _angles(np.add.reduce(others * last, axis=-2), length[..., :-1] * length[..., -1:], kind)


def _angles(product: np.ndarray, lengths: np.ndarray, kind: str) -> np.ndarray:
    """Distances by the angles of pairs of points with these products, of themselves and of their lengths."""
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = product / lengths
    if np.isnan(cosine.sum()):
        cosine = np.nan_to_num(cosine, nan=0.0)
    out = np.arccos(np.clip(cosine, -1, 1))
    return out * out if kind == "angular" else out


def cluster(nodes: Nodes, steps: int | None = None, embedding_update: str = "recompute", trace: list | None = None, **p) -> Nodes:
    """Merges the pair that is closest in the embedding, until the mean or least distance is too large.

    The choice is by suppressed distances, the stop by plain ones. No eigenvector in range means stop. With
    ``embedding_update`` "mean" a merged node gets the mean of its parts' coordinates instead of a new embedding, and
    the other nodes keep theirs with the distances between them.
    ``trace`` gets a row for every step: live nodes, dimensions, mean and least distance, labels of the pair, and
    lists of the live labels, the Laplacian row by row, its eigenvalues and the embedding row by row.
    """
    if nodes.n < 2:
        return nodes
    local, live = Local(nodes, p), np.arange(nodes.n)
    nodes.size[: nodes.n] = local.masked().sum(1)
    points, raw2, done = None, None, 0
    while len(live) > 1 and done != steps:
        if points is None or embedding_update == "recompute":
            raw2, points = None, embed(local.masked(), nodes.pt[live], nodes.size[live], p)
        lists: tuple = ()
        if trace is not None:
            matrix = graph_matrix(local.masked(), nodes.pt[live], nodes.size[live], p["Laplacian"])
            lists = (nodes.ints[live, 0].tolist(), matrix.ravel().tolist(), np.linalg.eigvalsh(matrix).tolist(), points.ravel().tolist())
        if not points.shape[1]:
            if trace is not None:
                trace.append((len(live), 0, np.nan, np.nan, -1, -1, *lists))
            break
        if raw2 is None:
            f = factor(p["ExpofPTFormatEmbedding"], p["ExpofPTEmbedding"], nodes.pt[live][:, None], nodes.pt[live][None, :])
            raw2 = embedding_distance2(points, p["EmbedDistance"]) * f * f
        distance2 = local.single * raw2
        i, j = divmod(int(distance2.argmin()), len(live))
        apart = np.sqrt(raw2)
        least = apart.min()
        np.fill_diagonal(apart, 0.0)
        mean = apart.sum() / (len(live) * (len(live) - 1))
        if trace is not None:
            trace.append((len(live), points.shape[1], float(mean), float(least), *(int(nodes.ints[live[k], 0]) for k in (i, j)), *lists))
        if p["MaxMeanDist"] is not None and not mean < p["MaxMeanDist"] or p["MaxMinDist"] is not None and not least < p["MaxMinDist"]:
            break
        if i == j:
            raise np.linalg.LinAlgError("no pair is closest")
        suppressed = local.single[i, j]
        new = nodes.merge(live[i], live[j], distance2[i, j])
        keep = np.array([k for k in range(len(live)) if k not in (i, j)], np.int64)
        if embedding_update == "mean":
            points = np.column_stack([points[keep].T, (points[i] + points[j]) / 2]).T
            f = factor(p["ExpofPTFormatEmbedding"], p["ExpofPTEmbedding"], nodes.pt[live[keep]], nodes.pt[new])
            raw2 = _bordered(raw2[np.ix_(keep, keep)], last_distance2(points.T, p["EmbedDistance"]) * f * f, np.inf)
        local.replace(live, keep, new)
        live = np.append(live[keep], new)
        nodes.size[live] = nodes.size[live] * suppressed + (1 - suppressed) * local.affine.sum(1)
        done += 1
    return nodes


def many(events: list[np.ndarray], embedding_update: str = "recompute", **p) -> list[tuple | None]:
    """The tables of :func:`cluster` for many small events, step by step of all; None for those whose decomposition fails."""
    return each_batch(events, lambda made: _together(made, embedding_update, p))


class _Part(NamedTuple):
    """Events with as many live nodes, each a row: its place, live nodes, suppressions and affinities; and if kept, the squared
    distances in the embedding and the coordinates, a dimension a row, with zeros for those that an event doesn't have."""

    event: np.ndarray
    live: np.ndarray
    single: np.ndarray
    affine: np.ndarray
    raw2: np.ndarray | None = None
    points: np.ndarray | None = None

    def where(self, ok: np.ndarray) -> _Part:
        return self if ok.all() else _Part(*(None if x is None else x[ok] for x in self))


def _joined(parts: list[_Part]) -> _Part:
    if len(parts) == 1:
        return parts[0]
    *same, points = zip(*parts, strict=True)
    dims = max(0 if x is None else x.shape[1] for x in points)
    wide = None if points[0] is None else np.concatenate([np.pad(x, ((0, 0), (0, dims - x.shape[1]), (0, 0))) for x in points])
    return _Part(*(None if x[0] is None else np.concatenate(x) for x in same), wide)


@lru_cache(maxsize=256)
def _upper(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and places of the pairs above the diagonal of a matrix, row by row."""
    i, j = np.triu_indices(n, 1)
    return i, j, i * n + j


def _picked(matrices: np.ndarray, places: np.ndarray) -> np.ndarray:
    return matrices.reshape(len(matrices), matrices.shape[1] ** 2).take(places, axis=1)


def _nearest(distance: np.ndarray, k: int) -> np.ndarray:
    """:func:`physics.nearest` of each matrix."""
    order = np.argsort(distance, axis=1, kind="stable")[:, : k + 1]
    mask = np.zeros(distance.shape, bool)
    np.put_along_axis(mask, order, True, axis=1)
    return mask | mask.transpose(0, 2, 1)


def _masked(affine: np.ndarray, k: int | None) -> np.ndarray:
    n = affine.shape[1]
    if k is None or k >= n:
        return affine
    # rows are columns here; where no other entry equals the least of the k, no order is needed
    mask = affine >= np.partition(affine, n - k, axis=2)[:, :, n - k, None]
    tied = np.flatnonzero((mask.sum(2) != k).any(1))
    mask |= mask.transpose(0, 2, 1)
    if len(tied):
        mask[tied] = _nearest(-affine[tied], k - 1)
    return np.where(mask, affine, 0.0)


def _matrices(affine: np.ndarray, pt: np.ndarray, size: np.ndarray, kind: str) -> np.ndarray:
    """:func:`graph_matrix` of each event."""
    out = 0.0 - affine
    diagonal, degrees = np.arange(affine.shape[1]), affine.sum(1)
    out[:, diagonal, diagonal] += degrees
    norm = {"unnormed": None, "symmetric": degrees, "pt": pt, "symmetric_carried": size}[kind]
    if norm is None:
        return out
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = 1 / np.sqrt(norm)
        out *= scale[:, :, None]
        out *= scale[:, None, :]
        return out if np.isfinite(out.sum()) else np.nan_to_num(out)


def _pairs(one: tuple, two: tuple, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Suppressions and plain affinities of nodes (pt, y, phi), as :class:`Local` has them."""
    near2 = ca_distance2(one[1], one[2], two[1], two[2])
    f = factor(p["ExpofPTFormatInput"], p["ExpofPTInput"], one[0], two[0])
    g = factor(p["ExpofPTFormatAffinity"], p["ExpofPTAffinity"], one[0], two[0])
    c = p["SingularitySuppression"]
    single = np.ones(near2.shape) if c is None else suppression(c, np.minimum(one[0], two[0]) * np.sqrt(near2))
    return single, affinity(near2 * f * f, p["Sigma"], p["ExpofPhysDistance"]) * g * g


def _together(made: Many, update: str, p: dict) -> np.ndarray:
    """Clusters all events of a batch, in groups with the same number of live nodes; the places of those that failed."""
    odd: list[int] = []
    waiting: dict[int, list[_Part]] = {}
    for n in np.unique(made.n[made.n > 1]).tolist():
        event = np.flatnonzero(made.n == n)
        live = np.broadcast_to(np.arange(n), (len(event), n)).copy()
        pt, y, phi = (made.floats[event, :n, k] for k in range(3))
        one, two = ((pt[:, :, None], y[:, :, None], phi[:, :, None]), (pt[:, None, :], y[:, None, :], phi[:, None, :]))
        single, affine = _pairs(one, two, p)
        affine *= single
        diagonal = np.arange(n)
        affine[:, diagonal, diagonal], single[:, diagonal, diagonal] = 0.0, 1.0
        made.floats[event, :n, 8] = _masked(affine, p["CutoffKNN"]).sum(2)
        part = _Part(event, live, single, affine)
        if update == "mean":
            part, raw2, points = _embedded(made, part, p, odd)
            i, j, _ = _upper(n)
            full = np.full((len(raw2), n, n), np.inf)
            full[:, i, j] = full[:, j, i] = raw2
            part = part._replace(raw2=full, points=points)
        waiting.setdefault(n, []).append(part)
    while waiting:
        n = max(waiting)
        part = _joined(waiting.pop(n))
        part, raw2, _ = _embedded(made, part, p, odd) if part.raw2 is None else (part, _picked(part.raw2, _upper(n)[2]), None)
        part = _step(made, part, raw2, p, odd)
        if n > 2 and len(part.event):
            waiting.setdefault(n - 1, []).append(part)
    return np.array(odd, np.int64)


def _step(made: Many, part: _Part, raw2: np.ndarray, p: dict, odd: list[int]) -> _Part:
    """One merge of each event that goes on, and these events; ``raw2`` are the distances in the embedding of the pairs of :func:`_upper`."""
    n = part.live.shape[1]
    one, two, places = _upper(n)
    with np.errstate(invalid="ignore"):
        distance2 = _picked(part.single, places) * raw2
        ok = np.ones(len(raw2), bool)
        if p["MaxMeanDist"] is not None:
            ok &= 2 * np.sqrt(raw2).sum(1) / (n * (n - 1)) < p["MaxMeanDist"]
        if p["MaxMinDist"] is not None:
            ok &= np.sqrt(raw2.min(1)) < p["MaxMinDist"]
    closest = distance2.argmin(1)
    least = np.take_along_axis(distance2, closest[:, None], 1)[:, 0]
    lost = ok & ~np.isfinite(least)
    odd += part.event[lost].tolist()
    ok &= ~lost
    part, closest, least = part.where(ok), closest[ok], least[ok]
    if not len(least):
        return part
    event, live, row = part.event, part.live, np.arange(len(part.event))
    i, j = one[closest], two[closest]
    suppressed = part.single[row, i, j]
    new = made.merge(event, live[row, i], live[row, j], least)
    stays = np.ones((len(row), n), bool)
    stays[row, i] = stays[row, j] = False
    keep = np.nonzero(stays)[1].reshape(len(row), n - 2)
    rest = np.take_along_axis(live, keep, 1)
    pt, y, phi = (made.floats[event[:, None], np.column_stack([rest, new]), k] for k in range(3))
    fresh = _pairs((pt[:, -1:], y[:, -1:], phi[:, -1:]), (pt[:, :-1], y[:, :-1], phi[:, :-1]), p)
    grid = (row[:, None] * n + keep)[:, :, None] * n + keep[:, None, :]
    single, affine = _bordered_all(part.single, grid, fresh[0], 1.0), _bordered_all(part.affine, grid, fresh[1], 0.0)
    live = np.column_stack([rest, new])
    at = (event[:, None], live, 8)
    made.floats[at] = made.floats[at] * suppressed[:, None] + (1 - suppressed[:, None]) * affine.sum(2)
    if part.raw2 is None:
        return _Part(event, live, single, affine)
    middle = (part.points[row, :, i] + part.points[row, :, j]) / 2
    points = np.concatenate([np.take_along_axis(part.points, keep[:, None, :], 2), middle[:, :, None]], axis=2)
    f = factor(p["ExpofPTFormatEmbedding"], p["ExpofPTEmbedding"], pt[:, :-1], pt[:, -1:])
    return _Part(event, live, single, affine, _bordered_all(part.raw2, grid, last_distance2(points, p["EmbedDistance"]) * f * f, np.inf), points)


def _bordered_all(matrices: np.ndarray, grid: np.ndarray, line: np.ndarray, corner: float) -> np.ndarray:
    """:func:`_bordered` of the parts of matrices at the places ``grid``."""
    n = line.shape[1]
    out = np.empty((len(line), n + 1, n + 1))
    out[:, :n, :n], out[:, n, :n], out[:, :n, n], out[:, n, n] = matrices.ravel().take(grid), line, line, corner
    return out


def _embedded(made: Many, part: _Part, p: dict, odd: list[int]) -> tuple[_Part, np.ndarray, np.ndarray]:
    """The events that have an embedding, its squared distances for the pairs of :func:`_upper`, and the coordinates of :func:`embed`."""
    pt, size = (made.floats[part.event[:, None], part.live, k] for k in (0, 8))
    matrix = _matrices(_masked(part.affine, p["CutoffKNN"]), pt, size, p["Laplacian"])
    good = np.ones(len(matrix), bool)
    try:
        values, vectors = np.linalg.eigh(matrix)
    except np.linalg.LinAlgError:
        values, vectors = np.zeros(matrix.shape[:2]), np.zeros(matrix.shape)
        for k, m in enumerate(matrix):
            try:
                values[k], vectors[k] = np.linalg.eigh(m)
            except np.linalg.LinAlgError:
                good[k] = False
    odd += part.event[~good].tolist()
    # values ascend, and the first is left out
    dims = np.where(good, (values <= p["EigenvalueLimit"]).sum(1) - 1, 0)
    ok = dims > 0
    part, pt, dims, values, vectors = part.where(ok), pt[ok], dims[ok], values[ok], vectors[ok]
    most = int(dims.max(initial=0))
    there = np.arange(most) < dims[:, None]
    scale = np.where(there, dimension_scaling(values[:, 1 : most + 1], p["Beta"], p["ClipBeta"]) if p["Beta"] else 1.0, 0.0)
    points = np.ascontiguousarray(vectors[:, :, 1 : most + 1].transpose(0, 2, 1))
    if p["EmbedHardness"] == "pt":
        scale = scale * (np.abs(points) * pt[:, None, :]).mean(2)
    points *= scale[:, :, None]
    raw2 = _distances(points, dims, p["EmbedDistance"])
    if p["ExpofPTFormatEmbedding"] is not None:
        one, two, _ = _upper(pt.shape[1])
        f = factor(p["ExpofPTFormatEmbedding"], p["ExpofPTEmbedding"], pt[:, one], pt[:, two])
        raw2 = raw2 * f * f
    return part, raw2, points


def _distances(points: np.ndarray, dims: np.ndarray, kind: str) -> np.ndarray:
    """:func:`embedding_distance2` of each event for the pairs of :func:`_upper`, to the last bit: near its end an arc of a cosine shows every one."""
    one, two, places = _upper(points.shape[2])
    if kind == "euclidiean":
        return np.stack([embedding_distance2(x[:d].T, kind).ravel()[places] for x, d in zip(points, dims, strict=True)]) if len(points) else np.zeros((0, len(one)))
    length = np.sqrt(np.add.reduce(np.square(points), axis=1))
    return _angles(_picked(points.transpose(0, 2, 1) @ points, places), length.take(one, 1) * length.take(two, 1), kind)
