"""Kernels that take many small events at once against the kernels of one event."""

import numpy as np
import pytest

from partonframe.operators.cluster import MANY, spectral_trace
from partonframe.operators.kernels import cone, genkt, physics, spectral, wavelet
from partonframe.operators.kernels.many import Many
from partonframe.operators.kernels.physics import Nodes, rapidity
from partonframe.plans.params import check_params


def events(count=60, most=40, seed=0):
    """Events of 1 to ``most`` particles with many equal momenta, so with many ties; some hold copies of a particle."""
    rng, out = np.random.default_rng(seed), []
    for n in rng.integers(1, most + 1, count):
        pt, y, phi, m = rng.integers(1, 6, n) * 1.0, rng.integers(-9, 10, n) / 4, rng.integers(0, 62, n) * 0.1 - np.pi, 1.01
        px, py, pz, energy = pt * np.cos(phi), pt * np.sin(phi), m * pt * np.sinh(y), m * pt * np.cosh(y)
        out.append(np.column_stack([px, py, pz, energy, np.hypot(px, py), rapidity(pt, pz, energy), np.arctan2(py, px)]))
    return out


def same(got, made, close=1e-12):
    want = (*made.table(), made.lifetimes())
    assert got is not None and [x.shape for x in got] == [x.shape for x in want]
    for k in (0, 1, 3):
        assert np.array_equal(got[k], want[k])
    assert np.allclose(got[2], want[2], rtol=close, atol=close, equal_nan=True)


@pytest.mark.parametrize("form, exponent", [(None, 0.0), ("genkt", -1.0), ("genkt", 1.0), ("ratiokt", 1.0), ("suppressedkt", 2.0)])
@pytest.mark.parametrize("delta_r", [0.4, 100.0])
def test_recombination(form, exponent, delta_r):
    how = {"DeltaR": delta_r, "ExpofPTFormatInput": form, "ExpofPTInput": exponent}
    some = events()
    for event, got in zip(some, genkt.many(some, **how), strict=True):
        same(got, genkt.cluster(Nodes(*event.T), **how))


def test_an_event_without_finite_distances_is_left_to_the_kernel_of_one():
    some = events(5)
    some[2] = some[2].copy()
    some[2][:, 4] = 0.0
    how = {"DeltaR": 0.4, "ExpofPTFormatInput": "genkt", "ExpofPTInput": -1.0}
    assert [k for k, x in enumerate(genkt.many(some, **how)) if x is None] == [2]


@pytest.mark.parametrize("update", ["recompute", "mean"])
@pytest.mark.parametrize("more", [{}, {"EmbedDistance": "euclidiean", "CutoffKNN": None, "Laplacian": "pt", "EmbedHardness": "pt"}, {"EmbedDistance": "angular", "SingularitySuppression": None, "Laplacian": "symmetric", "MaxMinDist": 0.3}, {"MaxMeanDist": None, "EigenvalueLimit": 2.0}])
def test_spectral(update, more):
    how = check_params("Spectral", more)
    how.pop("PhyDistance")
    some = events(40, seed=1)
    for event, got in zip(some, spectral.many(some, embedding_update=update, **how), strict=True):
        same(got, spectral.cluster(Nodes(*event.T), embedding_update=update, **how), 1e-6)  # arcs of cosines near 1 show their last bits


def test_trace_of_the_first_steps(spark):
    rows = [(e, i, *map(float, r[:4])) for e, event in enumerate(events(6)) for i, r in enumerate(event)]
    df = spark.createDataFrame(rows, "event_id long, idx long, px double, py double, pz double, energy double")
    every = sorted(map(str, spectral_trace(df).where("step < 2").collect()))  # as text, for NaN
    assert sorted(map(str, spectral_trace(df, steps=2).collect())) == every


def test_wavelets_at_the_first_seed():
    some = [e[:, [5, 6, 4]] for e in events() if len(e) > 1]
    for e, got in zip(some, wavelet.first_scaled(some), strict=True):
        y, phi, pt = e.T
        want = wavelet.scaled(wavelet.wavelet(wavelet.graph(y, phi, 0.1), int(wavelet.seeds(y, phi, pt)[0])))
        assert np.allclose(got, want, atol=1e-9, equal_nan=True)


def test_a_step_lists_no_ties_and_angles_within_a_turn_need_no_remainder(monkeypatch):
    """Far particles of C/A tie with the beam, all at every step; listing them made steps grow with the square of an event."""
    n, listed = 60, []

    class Counted:
        def __getattr__(self, name):
            return getattr(np, name)

        def nonzero(self, x):
            found = np.nonzero(x)
            listed.append(len(found[0]))
            return found

        def mod(self, *_):
            raise AssertionError("a remainder of angles within a turn")

    phi = np.linspace(-3.0, 3.0, n)
    y = np.arange(n) * 1.0 - n / 2
    event = np.column_stack([np.cos(phi), np.sin(phi), np.sinh(y), np.cosh(y), np.ones(n), y, phi])
    want = genkt.cluster(Nodes(*event.T), DeltaR=0.4)
    monkeypatch.setattr(genkt, "np", Counted())
    made = Many([event])
    assert not len(genkt._together(made, 0.16, 0.0, None)) and sum(listed) <= 2 * n
    assert np.array_equal(made.last[0, :n], want.last[:n])
    monkeypatch.setattr(physics, "np", Counted())
    assert physics.angle_gap(phi[:, None], phi).max() <= np.pi


@pytest.mark.parametrize("form, exponent", [(None, 0.0), ("genkt", -1.0), ("ratiokt", 1.0)])
@pytest.mark.parametrize("delta_r, threshold", [(0.6, 1.0), (3.0, 0.0), (0.3, 4.0)])
def test_cones(form, exponent, delta_r, threshold):
    how = {"DeltaR": delta_r, "SeedThreshold": threshold, "ExpofPTFormatInput": form, "ExpofPTInput": exponent}
    some = events()
    some[3] = some[3].copy()
    some[3][0, 5] = np.inf
    for k, (event, got) in enumerate(zip(some, MANY[cone.cluster](some, **how), strict=True)):
        assert got is None if k == 3 else same(got, cone.cluster(Nodes(*event.T), **how)) is None


@pytest.mark.parametrize("more", [{}, {"NRounds": 5}, {"Cutoff": 0.3, "Sigma": 0.5}, {"Normalised": False}])
def test_wavelets(more):
    how = check_params("CALE", more)
    some = events(200, 8, 2) + events(20, 40, 3)
    for event, got in zip(some, MANY[wavelet.cluster](some, **how), strict=True):
        assert got is None if len(event) > 2 * how["NRounds"] else same(got, wavelet.cluster(Nodes(*event.T), **how)) is None


class Arcs:
    """numpy that counts the arcs and refuses to sort."""

    def __init__(self):
        self.arcs = 0

    def __getattr__(self, name):
        return getattr(np, name)

    def arccos(self, x):
        self.arcs += x.size
        return np.arccos(x)

    def argsort(self, *_, **__):
        raise AssertionError("nearest nodes of events without ties need no order")


def random_events(count, n, seed=5):
    p = np.random.default_rng(seed).uniform(-10, 10, (count, n, 3))
    energy, pt = np.linalg.norm(p, axis=2) + 1, np.hypot(p[:, :, 0], p[:, :, 1])
    return list(np.stack([*p.transpose(2, 0, 1), energy, pt, rapidity(pt, p[:, :, 2], energy), np.arctan2(p[:, :, 1], p[:, :, 0])], axis=2))


@pytest.mark.parametrize("update, together", [("recompute", True), ("mean", True), ("mean", False)])
def test_spectral_steps_take_each_pair_once(monkeypatch, update, together):
    """A step took the arcs of all pairs in both orders; with "mean" only those of the new node are other than before."""
    how, some, n = check_params("Spectral", {"MaxMeanDist": None}), random_events(6, 20), 20
    how.pop("PhyDistance")
    counted = Arcs()
    monkeypatch.setattr(spectral, "np", counted)
    made = spectral.many(some, embedding_update=update, **how) if together else [(0, spectral.cluster(Nodes(*e.T), embedding_update=update, **how).table()[1]) for e in some]
    pairs = n * (n - 1) // 2
    for event, found in zip(some, made, strict=True):
        merges = len(found[1]) - n
        assert merges > 10
        counted.arcs -= sum((n - k) * (n - k - 1) // 2 for k in range(merges + 1)) if update == "recompute" else pairs + sum(n - 2 - k for k in range(merges))
    assert counted.arcs <= (0 if together else len(some) * (n * n - pairs))
