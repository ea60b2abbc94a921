"""Kernels against literal expectations, brute force and properties."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from partonframe.operators.kernels import cone, genkt, kmeans, spectral, tiled, wavelet
from partonframe.operators.kernels import physics as P
from partonframe.plans.params import defaults
from partonframe.plans.queries import GOLDEN, GOLDEN_JETS


def nodes(px, py, pz, energy):
    px, py, pz, energy = (np.asarray(x, float) for x in (px, py, pz, energy))
    pt = np.hypot(px, py)
    return P.Nodes(px, py, pz, energy, pt, P.rapidity(pt, pz, energy), np.arctan2(py, px))


def event(seed, n):
    rng = np.random.default_rng(seed)
    p = rng.uniform(-10, 10, (n, 3))
    return nodes(*p.T, np.linalg.norm(p, axis=1) + rng.uniform(0.1, 2, n))


def spectral_params(**more):
    out = defaults("Spectral") | more
    out.pop("PhyDistance")
    return out


def test_identical_particles_merge_at_once():
    found = genkt.cluster(nodes([1, 1], [0, 0], [0, 0], [1, 1]), DeltaR=0.001)
    root, ints, floats = found.table()
    assert ints[2].tolist() == [2, -1, 0, 1, 0] and root.tolist() == [2, 2, 2]
    assert floats[2, 3] == 2 and floats[2, 7] == 0 and floats[2, 8] == 2


@pytest.mark.parametrize(("exponent", "form"), [(0, None), (1, "genkt"), (-1, "genkt")])
def test_close_particles_merge_within_their_distance(exponent, form):
    close = lambda: nodes([1, math.cos(0.1)], [0, math.sin(0.1)], [0, 0], [1, 1])
    assert genkt.cluster(close(), 0.001, exponent, form).used == 2
    root, ints, floats = genkt.cluster(close(), 0.5, exponent, form).table()
    assert floats[2, 0] == pytest.approx(2 * math.cos(0.05)) and floats[2, 2] == pytest.approx(0.05) and floats[2, 7] == pytest.approx(0.1)


def test_opposite_particles_stay_apart():
    assert genkt.cluster(nodes([1, -1], [0, 0], [0, 0], [1, 1]), 0.5).used == 2


def brute_genkt(px, py, pz, e, radius, exponent):
    """Plain lists: (sum of momenta as a set of leaves) per jet."""
    live = [((i,), np.array([px[i], py[i], pz[i], e[i]])) for i in range(len(px))]
    done = []

    def kin(p):
        pt = math.hypot(p[0], p[1])
        rest = max(p[3] ** 2 - p[2] ** 2 - pt**2, 0)
        y = 0.0 if p[2] == 0 else math.copysign(0.5 * math.log((pt**2 + rest) / (p[3] - abs(p[2])) ** 2), p[2])
        return pt, y, math.atan2(p[1], p[0])

    while len(live) > 1:
        best = None
        for i, (_, a) in enumerate(live):
            for j, (_, b) in enumerate(live):
                (pa, ya, fa), (pb, yb, fb) = kin(a), kin(b)
                if i == j:
                    d = radius**2 * pa ** (2 * exponent)
                else:
                    gap = abs(fa - fb) % (2 * math.pi)
                    gap = min(gap, 2 * math.pi - gap)
                    d = (gap**2 + (ya - yb) ** 2) * min(pa**exponent, pb**exponent) ** 2
                if best is None or d < best[0] - 1e-15:
                    best = (d, i, j)
        _, i, j = best
        if i == j:
            done.append(live.pop(i)[0])
        else:
            merged = (live[i][0] + live[j][0], live[i][1] + live[j][1])
            live = [x for k, x in enumerate(live) if k not in (i, j)] + [merged]
    return {frozenset(x) for x in done + [live[0][0]]}


@pytest.mark.parametrize("exponent", [-1.0, 0.0, 1.0])
@pytest.mark.parametrize("seed", range(8))
def test_sequential_recombination_equals_brute_force(seed, exponent):
    e = event(seed, 9)
    px, py, pz, energy = e.floats[:9, 4], e.floats[:9, 5], e.floats[:9, 6], e.floats[:9, 3]
    want = brute_genkt(px, py, pz, energy, 0.9, exponent)
    root, ints, _ = genkt.cluster(e, 0.9, exponent, "genkt").table()
    got = {frozenset(np.flatnonzero((root == r) & (ints[:, 2] == -1)).tolist()) for r in set(root.tolist())}
    assert got == want


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(0, 14))
def test_trees_are_consistent(seed, n):
    for found in (genkt.cluster(event(seed, n), 0.8, -1, "genkt"), spectral.cluster(event(seed, n), **spectral_params())):
        root, ints, floats = found.table()
        leaves, tops = ints[:, 2] == -1, ints[:, 1] == -1
        assert leaves.sum() == n and len(ints) == 2 * n - tops.sum()
        assert np.allclose(floats[tops, 3:7].sum(0), floats[leaves, 3:7].sum(0))
        for label, parent, one, two, _ in ints.tolist():
            assert one < label and two < label and (parent == -1 or parent > label)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 40), st.sampled_from([(0.0, None), (1.0, "genkt"), (-1.0, "genkt"), (1.0, "ratiokt")]))
def test_nearest_neighbours_give_what_all_distances_give(seed, n, how):
    rng = np.random.default_rng(seed)
    # few different directions, so that there are ties
    p = rng.integers(-2, 3, (n, 3)).astype(float) + np.where(rng.random() < 0.5, 0.0, rng.normal(0, 1, (n, 3)))
    p[:, 0] += 3.5
    make = lambda: nodes(*p.T, np.linalg.norm(p, axis=1) + 0.5)
    before, genkt.MOST_DENSE = genkt.MOST_DENSE, 0
    try:
        slow = genkt.cluster(make(), 0.7, *how).table()
    finally:
        genkt.MOST_DENSE = before
    fast = genkt.cluster(make(), 0.7, *how).table()
    assert np.array_equal(slow[0], fast[0]) and np.array_equal(slow[1], fast[1])


def shower(seed, n):
    """Particles spread over the plane, of unequal momenta, some of them twice."""
    rng = np.random.default_rng(seed)
    y, phi, pt = rng.normal(0, 2.5, n), rng.uniform(-np.pi, np.pi, n), rng.pareto(2, n) + 0.1
    p = np.column_stack([pt * np.cos(phi), pt * np.sin(phi), pt * np.sinh(y), pt * np.cosh(y) * 1.0001])
    copies = rng.integers(0, n, n // 10)
    p[rng.integers(0, n, n // 10)] = p[copies]
    return lambda: nodes(*p.T)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 200), st.sampled_from([0.01, 0.4, 1.0, 2.5, 7.0, 100.0]), st.sampled_from([(0.0, None), (1.0, "genkt"), (-1.0, "genkt"), (0.3, "genkt")]))
def test_grids_give_what_all_distances_give(seed, n, delta_r, how):
    make = shower(seed, n)

    def run(kind, *more):
        made = make()
        pairs = kind(made, delta_r, *how, *more)
        for _ in range(n - 1):
            i, j, distance2 = pairs.closest()
            if i == j:
                made.retire(i)
            pairs.replace(i, j, made.merge(i, j, distance2) if i != j else None)
        return made

    slow, fast = run(genkt.Dense), run(tiled.Tiled, genkt.TIE)
    assert np.array_equal(slow.ints[: slow.used], fast.ints[: fast.used]) and np.array_equal(slow.lifetimes(), fast.lifetimes())
    assert np.allclose(slow.floats[: slow.used], fast.floats[: fast.used], rtol=1e-9, atol=1e-12)


def test_grids_close_on_themselves_in_azimuth():
    px, py, pz = np.array([1.0, 1, 3, 2]), [1e-3, -1e-3, 0, 1], [0.1, 0.1, 0.2, 3]
    for turn in (1, -1):  # azimuths around 0, then around pi
        tables = []
        for kind, *more in ((genkt.Dense,), (tiled.Tiled, genkt.TIE)):
            made = nodes(turn * px, py, pz, [1.1, 1.1, 3.1, 4])
            pairs = kind(made, 0.4, 1.0, "genkt", *more)
            for _ in range(3):
                i, j, d = pairs.closest()
                pairs.replace(i, j, made.merge(i, j, d) if i != j else None)
            tables.append(made.table()[1])
        assert np.array_equal(*tables) and (tables[0][:2, 1] == 4).all()


def test_particles_of_infinite_rapidity_meet_the_beam_only():
    made = nodes([0, 0, 1, 1], [0, 0, 0, 0.1], [5, -5, 0.1, 0.1], [5, 5, 1.1, 1.1])
    pairs = tiled.Tiled(made, 0.4, 1.0, "genkt", genkt.TIE)
    taken = []
    for _ in range(3):
        i, j, d = pairs.closest()
        taken.append((i, j))
        pairs.replace(i, j, made.merge(i, j, d) if i != j else None)
    assert taken == [(0, 0), (1, 1), (2, 3)]


def test_an_event_of_many_particles_is_clustered_on_grids():
    made = genkt.cluster(shower(3, 6000)(), 0.4, -1.0, "genkt")
    root, ints, floats = made.table()
    jets = np.flatnonzero(ints[:, 1] < 0)
    assert floats[jets, 8].sum() == 6000 and np.allclose(floats[jets, 3].sum(), floats[:6000, 3].sum())
    # every jet's parts were nearer to one another than to the beam
    assert (floats[6000:, 7] >= 0).all() and len(jets) > 100


def brute_spectral(px, py, pz, e, mean_update=False, sigma=0.15, knn=5, limit=0.4, beta=1.4, clip=1e-3, single=1e-4, stop=1.26):
    """Spectral clustering with the default parameters, from scratch at every step; the jets as sets of particles."""
    live = [({i}, np.array([px[i], py[i], pz[i], e[i]])) for i in range(len(px))]

    def kin(p):
        pt = math.hypot(p[0], p[1])
        rest = max(p[3] ** 2 - p[2] ** 2 - pt**2, 0)
        return pt, 0.0 if p[2] == 0 else math.copysign(0.5 * math.log((pt**2 + rest) / (p[3] - abs(p[2])) ** 2), p[2]), math.atan2(p[1], p[0])

    def apart(a, b):
        gap = abs(a[2] - b[2]) % (2 * math.pi)
        return min(gap, 2 * math.pi - gap) ** 2 + (a[1] - b[1]) ** 2

    def soft(a, b):
        return 1 - single / (single + min(a[0], b[0]) * math.sqrt(apart(a, b)))

    parts, sizes, points, made = [frozenset(s) for s, _ in live], None, None, set()
    while len(live) > 1:
        k = [kin(p) for _, p in live]
        n = len(live)
        near2 = [[apart(a, b) for b in k] for a in k]
        single_ = np.array([[1.0 if i == j else soft(k[i], k[j]) for j in range(n)] for i in range(n)])
        aff = np.array([[0.0 if i == j else math.exp(-near2[i][j] / sigma) * (1.0 if parts[i] in made or parts[j] in made else single_[i, j]) for j in range(n)] for i in range(n)])
        if any(x in made for x in parts):
            for i in range(n):
                for j in range(n):
                    if i != j and (parts[i] in made or parts[j] in made):
                        single_[i, j] = soft(k[i], k[j])
        mask = np.zeros((n, n), bool)
        for j in range(n):
            for i in sorted(range(n), key=lambda i: (-aff[i, j], i))[:knn]:
                mask[i, j] = mask[j, i] = True
        masked = np.where(mask, aff, 0)
        if sizes is None:
            sizes = masked.sum(1)
        if points is None or not mean_update:
            lap = np.diag(masked.sum(0)) - masked
            lap = lap / np.sqrt(np.outer(sizes, sizes))
            values, vectors = np.linalg.eigh(lap)
            chosen = [i for i in range(n) if values[i] <= limit][1:]
            points = vectors[:, chosen] * np.maximum(values[chosen], clip) ** -beta
        if not points.shape[1]:
            break
        raw = np.full((n, n), np.inf)
        for i in range(n):
            for j in range(n):
                if i != j:
                    cosine = points[i] @ points[j] / (np.linalg.norm(points[i]) * np.linalg.norm(points[j]))
                    raw[i, j] = math.acos(min(max(cosine, -1), 1))
        i, j = divmod(int((raw * single_).argmin()), n)
        if not np.sqrt(raw[~np.eye(n, dtype=bool)]).mean() < stop:
            break
        factor = single_[i, j]
        keep = [x for x in range(n) if x not in (i, j)]
        live = [live[x] for x in keep] + [(live[i][0] | live[j][0], live[i][1] + live[j][1])]
        parts = [frozenset(s) for s, _ in live]
        made.add(parts[-1])
        if mean_update:
            points = np.vstack([points[keep], (points[i] + points[j]) / 2])
        k = [kin(p) for _, p in live]
        full = np.array([[0.0 if a == b else math.exp(-apart(k[a], k[b]) / sigma) * (1.0 if parts[a] in made or parts[b] in made else soft(k[a], k[b])) for b in range(len(k))] for a in range(len(k))])
        # a new node starts from size 1 of each of its parts
        merged = sizes[i] + sizes[j]
        sizes = np.append(sizes[keep], merged)
        sizes = sizes * factor + (1 - factor) * full.sum(1)
    return sorted(sorted(s) for s, _ in live)


@pytest.mark.parametrize("mean", [False, True])
def test_golden_jets_equal_a_second_implementation(mean):
    for events in GOLDEN, [np.column_stack([event(s, 9).floats[:9, c] for c in (4, 5, 6, 3)]).tolist() for s in range(12)]:
        for k, one in enumerate(events):
            px, py, pz, e = np.array(one).T
            root, _, _ = spectral.cluster(nodes(px, py, pz, e), embedding_update="mean" if mean else "recompute", **spectral_params()).table()
            jets = sorted(sorted(np.flatnonzero(root[: len(px)] == r).tolist()) for r in set(root[: len(px)].tolist()))
            assert jets == brute_spectral(px, py, pz, e, mean)
            if events is GOLDEN:
                assert jets == sorted(GOLDEN_JETS["SpectralMean" if mean else "Spectral"][k])


def test_steps_of_spectral_clustering_can_be_read():
    steps = []
    spectral.cluster(event(3, 8), trace=steps, **spectral_params())
    for n_live, n_dims, *_, labels, laplacian, values, embedding in steps:
        assert len(labels) == len(values) == n_live and len(laplacian) == n_live**2 and len(embedding) == n_live * n_dims
        assert np.allclose(np.linalg.eigvalsh(np.reshape(laplacian, (n_live, n_live))), values)


def test_one_step_then_another_run_equals_one_run():
    for seed in range(5):
        whole = genkt.cluster(event(seed, 8), 50.0, 1, "genkt").table()
        first = genkt.cluster(event(seed, 8), 50.0, 1, "genkt", steps=1)
        i, j = first.ints[8, 2:4]
        live = [k for k in range(9) if k not in (i, j)]
        px, py, pz, e = (first.floats[live, c] for c in (4, 5, 6, 3))
        again = genkt.cluster(nodes(px, py, pz, e), 50.0, 1, "genkt").table()
        assert np.allclose(again[2][-1, :7], whole[2][-1, :7], atol=5e-4)


def test_wavelet_golden_event():
    np.random.seed(42)
    energy = np.random.rand(10) * 10 + 2
    px, py, pz = (np.random.rand(10) * 2 - 1 for _ in range(3))
    root, ints, floats = wavelet.cluster(nodes(px, py, pz, energy), Sigma=0.1, Cutoff=0, NRounds=15).table()
    assert root[:10].tolist() == [10, 10, 10, 10, 10, 10, 11, 10, 10, 12]
    assert ints[10:].tolist() == [[10, -1, 10, 10, 0], [11, -1, 11, 11, 0], [12, -1, 12, 12, 0]]
    assert np.isnan(floats[10:, 7]).all() and floats[10:, 8].tolist() == [8, 1, 1]


@pytest.mark.parametrize("n", [0, 1])
def test_small_events(n):
    assert wavelet.cluster(event(1, n)).used == 2 * n
    assert cone.cluster(event(1, n), SeedThreshold=0.0).used == 2 * n
    assert genkt.cluster(event(1, n)).used == n
    assert spectral.cluster(event(1, n), **spectral_params()).used == n


def test_cluster_particles_gives_labels_and_lists():
    label, lists = wavelet.cluster_particles([0.0, 0.1, 2.0], [0.0, 0.1, 2.0], [1.0, 2.0, 3.0])
    assert sorted(i for x in lists for i in x) == np.flatnonzero(label).tolist()
    assert wavelet.cluster_particles([], [], [])[1] == []


def test_chebyshev_coefficients_agree_with_a_fit():
    from numpy.polynomial import chebyshev

    c = wavelet.coefficients(np.exp, 8, 50)
    fit = chebyshev.Chebyshev.interpolate(np.exp, 8).coef
    c[0] *= 2  # the constant one is halved by convention
    assert np.allclose(c, fit * np.r_[2, np.ones(8)], atol=1e-6)


def test_filtered_signals():
    f = np.array([1.0, 2.0])
    assert np.allclose(wavelet.filtered(f, np.eye(2), [2.0, 3.0], (-1, 1)), [f * 4])
    assert np.allclose(wavelet.filtered(f, np.zeros((2, 2)), [[1.0], [2.0]], (-1, 1)), np.zeros((2, 2)))
    assert wavelet.checked(3).tolist() == [[3]] and wavelet.checked([1, 2]).tolist() == [[1, 2]]
    for bad in ([], [[1], [1, 2]]):
        with pytest.raises(ValueError):
            wavelet.checked(bad)


def test_scales():
    assert wavelet.scales(0, 2, 1).tolist() == [2]
    many = wavelet.scales(0, 2, 4)
    assert many[0] == pytest.approx(2) and many[-1] == pytest.approx(0) and (np.diff(many) < 0).all()


def test_laplacians():
    a = np.array([[0, 1.0], [1, 0]])
    assert P.laplacian(a, None).tolist() == [[1, -1], [-1, 1]]
    assert P.laplacian(a, a.sum(0)).tolist() == [[1, -1], [-1, 1]]
    assert P.laplacian(np.zeros((2, 2)), np.zeros(2)).tolist() == [[0, 0], [0, 0]]


def test_nearest_is_symmetric_and_keeps_k_others():
    d = np.abs(np.subtract.outer([3.0, 1.0, 2.5], [3.0, 1.0, 2.5]))
    assert P.nearest(d, 1).tolist() == [[True, False, True], [False, True, True], [True, True, True]]


def test_cones_take_the_hardest_first():
    found = cone.cluster(nodes([10, 9.9, -5, 0.1], [0, 1, 0, 0], [0, 0, 0, 0], [10, 10, 5, 0.1]), DeltaR=0.5, SeedThreshold=1.0)
    root, ints, _ = found.table()
    assert root[0] == root[1] != root[2] and ints[:4, 1].tolist()[2] >= 0
    assert root[3] == root[0]  # soft, but inside the cone


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 1000), st.integers(1, 4))
def test_kmeans_assigns_every_point_to_its_nearest_centre(seed, k):
    points = np.random.default_rng(seed).normal(size=(12, 2))
    labels, centres, score = kmeans.fit(points, k, seed=seed)
    gaps = kmeans.euclidean(points, centres)
    assert np.allclose(gaps[np.arange(12), labels], gaps.min(1)) and score == pytest.approx(gaps.min(1).sum())


def test_kmeans_rejects_impossible_numbers():
    for k in (0, 3):
        with pytest.raises(ValueError):
            kmeans.fit(np.zeros((2, 2)), k)


def test_kmeans_of_many_groups_together_is_that_of_one_after_another():
    rng = np.random.default_rng(3)
    groups = [rng.normal(size=(n, 2)) for n in [1, 2, 3, 17, 40, 40, 9, 33, 1, 2] * 4]
    groups += [np.zeros((5, 2)), np.ones((7, 2)), np.where(rng.random((12, 2)) < 0.2, np.nan, rng.normal(size=(12, 2)))]
    want = [kmeans.fit(g, min(3, len(g)), patience=2)[0].tolist() for g in groups]
    assert [x.tolist() for x in kmeans.many(groups, 3, patience=2)] == want
    city = lambda points, centres: np.abs(points[:, None] - centres[None]).sum(2)
    assert [x.tolist() for x in kmeans.many(groups[:10], 3, city)] == [kmeans.fit(g, min(3, len(g)), city)[0].tolist() for g in groups[:10]]


@pytest.mark.parametrize("n, rounds, cutoff", [(1, 15, 0.0), (2, 15, 0.0), (30, 15, 0.0), (60, 4, 0.5), (60, 60, -0.6), (25, 0, 0.0)])
def test_wavelets_of_many_seeds_at_once_are_those_of_one_after_another(n, rounds, cutoff):
    made = event(n, n)
    y, phi, pt = (x[:n] for x in (made.y, made.phi, made.pt))
    matrix, free, want = wavelet.graph(y, phi, 0.1), np.ones(n, bool), []
    for seed in wavelet.seeds(y, phi, pt):
        if len(want) < rounds and free[seed]:
            want.append(np.flatnonzero(free & (wavelet.scaled(wavelet.wavelet(matrix, seed)) < cutoff)))
            free[want[-1]] = False
    found = wavelet.groups(y, phi, pt, 0.1, cutoff, rounds)
    assert [g.tolist() for g in found] == [g.tolist() for g in want]
    some = np.arange(n)[::2]
    assert np.allclose(wavelet.wavelets(matrix, some), np.column_stack([wavelet.wavelet(matrix, s) for s in some]))
