"""States of a clustering at any step, and ties whose last bits differ."""

import math
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from partonframe.operators import history
from partonframe.operators.cluster import KERNELS, cluster
from partonframe.operators.kernels import cone, genkt, spectral
from partonframe.plans.queries import QUERIES
from tests.test_kernels import event, nodes, spectral_params
from tests.test_operators import particles

ALGORITHMS = {"antikt": ("GeneralisedKT", {"DeltaR": 0.7, "ExpofPTFormatInput": "genkt", "ExpofPTInput": -1.0}), "ca": ("GeneralisedKT", {"DeltaR": 1.5}), "spectral": ("Spectral", {}), "mean": ("SpectralMean", {})}


def live(found):
    """Labels of the rows that no step has merged or retired, from the pointers and the number of steps alone."""
    return sorted(int(x) for x in found.ints[: found.used, 0][found.last[: found.used] < 0])


@pytest.mark.parametrize("n", [0, 1, 2, 9, 30])
def test_intervals_are_the_states_of_runs_that_stop_earlier(n):
    for kernel in (partial(genkt.cluster, DeltaR=0.7, ExpofPTInput=-1.0, ExpofPTFormatInput="genkt"), partial(spectral.cluster, **spectral_params())):
        whole = kernel(event(7, n))
        lives, labels = whole.lifetimes(), whole.ints[: whole.used, 0]
        for step in range(whole.step + 1):
            assert sorted(labels[(lives[:, 0] <= step) & (lives[:, 1] >= step)].tolist()) == live(kernel(event(7, n), steps=step))
            assert len(live(kernel(event(7, n), steps=step))) == n - step


def test_large_events_have_the_same_history(monkeypatch):
    found = genkt.cluster(event(5, 60), 0.9).lifetimes()
    monkeypatch.setattr(genkt, "MOST_DENSE", 1)
    assert genkt.cluster(event(5, 60), 0.9).lifetimes().tolist() == found.tolist()


@pytest.mark.parametrize("name", sorted(ALGORITHMS))
def test_states_of_tables(spark, name):
    algorithm, params = ALGORITHMS[name]
    p = particles(spark, [0, 1, 2, 8, 15]).cache()
    found = history.history(p, algorithm, params).cache()
    rows = found.toPandas()
    by = {e: g for e, g in rows.groupby("event_id")}
    for step in (0, 3, 40):
        got = {(r.event_id, r.label) for r in history.at_step(found, step).collect()}
        assert got == {(e, x) for e, g in by.items() for x in g[(g.born <= step) & (g["last"] >= step)].label}
    assert history.at_step(found, 0).count() == p.count()
    # one state is asked for twice, one doesn't exist, one event isn't there
    asked = spark.createDataFrame([(3, 2), (3, 2), (4, 0), (4, 99), (77, 0)], "event_id long, step int")
    states = history.at_steps(found, asked).groupBy("event_id", "step").count().collect()
    taken = {e: int(g["last"].max()) for e, g in by.items()}
    assert {(r.event_id, r.step): r["count"] for r in states} == ({(3, 2): 2 * (8 - 2)} if taken[3] >= 2 else {}) | {(4, 0): 15}
    # what is left at the end: all roots that weren't retired
    left = {(r.event_id, r.label) for r in history.available(found).collect()}
    assert left == {(e, x) for e, g in by.items() for x in g[g["last"] == g["last"].max()].label} and len({e for e, _ in left}) == 4
    sums = history.running(found, {"n": F.lit(1), "labels": F.col("label")}).collect()
    assert len(sums) == sum(t + 1 for t in taken.values())
    for r in sums:
        g = by[r.event_id]
        now = g[(g.born <= r.step) & (g["last"] >= r.step)]
        assert (r.n, r.labels) == (len(now), now.label.sum())


def test_minor_of_a_matrix(spark):
    found = history.history(particles(spark, [6]), "GeneralisedKT", {"DeltaR": 100.0}).cache()
    pairs = history.live_pairs(found, ["pt"]).cache()
    g = found.toPandas().set_index("label")
    met = lambda i, j: max(g.born[i], g.born[j]) <= min(g["last"][i], g["last"][j])
    assert {(r.i, r.j) for r in pairs.collect()} == {(i, j) for i in g.index for j in g.index if i < j and met(i, j)}
    matrix = spark.createDataFrame([(0, i, j, float(10 * i + j)) for i in range(11) for j in range(11)], "event_id long, i long, j long, value double")
    for step in range(6):
        now = set(g[(g.born <= step) & (g["last"] >= step)].index)
        assert {(r.i, r.j) for r in history.at_step(pairs, step).collect()} == {(i, j) for i in now for j in now if i < j}
        assert {(r.i, r.j): r.value for r in history.minor(matrix, history.at_step(found, step)).collect()} == {(i, j): 10.0 * i + j for i in now for j in now}


def test_partitions_and_failed_events_have_no_steps(spark):
    p = particles(spark, [5, 3])
    found = history.history(p, "CALE")
    assert found.agg(F.max("born"), F.max("last")).first() == (0, 0) and found.where("child1 = -1").count() == 8
    lost = cluster(p, "Spectral", {}, most_particles=4, lived=True)
    assert {(r.event_id, r.status, r.born) for r in lost.where("status != 'ok'").collect()} == {(0, "too_large", None)}
    assert set(KERNELS) >= {a for a, _ in ALGORITHMS.values()}


def turned(angle, x, y):
    return x * math.cos(angle) - y * math.sin(angle), x * math.sin(angle) + y * math.cos(angle)


def test_hardest_particles_that_differ_in_the_last_bits_are_a_tie():
    """Rotations of one particle have equal momenta but for rounding; the first seeds, wherever rounding falls."""
    differ = 0
    for k in range(60):
        px, py = zip(*(turned(0.37 * k + a, 50.0, 0.0) for a in (0.0, 0.5, 3.0)), strict=True)
        pt = np.hypot(px, py)
        differ += pt[0] != pt.max()
        root, ints, _ = cone.cluster(nodes(px, py, [0.0] * 3, [50.0] * 3), DeltaR=0.6).table()
        assert root.tolist()[:3] == [3, 3, 4] and ints[3, 2] == 3
    assert differ


def test_beam_distances_that_agree_are_taken_in_order():
    """Far particles of one momentum retire by index, whatever slots they stand in and however they are rounded."""
    for k in range(40):
        px, py = zip(*(turned(0.37 * k + a, 50.0, 0.0) for a in (0.0, 1.5, 3.0, 4.5)), strict=True)
        for most in (genkt.MOST_DENSE, 1):
            made = nodes(px, py, [0.0] * 4, [50.0] * 4)
            pairs = (genkt.Dense if made.n <= most else genkt.Nearest)(made, 0.4, -1.0, "genkt")
            order = []
            for _ in range(3):
                i, j, _ = pairs.closest()
                order.append((i, j))
                pairs.replace(i, j, None)
            assert order == [(0, 0), (1, 1), (2, 2)]


def clusterings(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_running_sums_cluster_once(spark):
    found = history.history(particles(spark, [6]), "GeneralisedKT", {"DeltaR": 0.7})
    assert clusterings(history.running(found, {"n": F.lit(1)})) == 1


def test_steps_that_all_events_share_need_no_join(spark):
    found = history.history(particles(spark, [0, 1, 2, 8, 15]), "GeneralisedKT", {"DeltaR": 0.7})
    steps = (0, 3, 9)
    want = found.select("event_id").distinct().withColumn("step", F.explode(F.array(*map(F.lit, steps))))
    pairs = history.live_pairs(found, ["pt"])
    few = history.by_step(history.live_pairs(history.ever(found, steps), ["pt"]), steps, {"total": (F.sum, F.col("pt_i"))})
    every = history.at_steps(pairs, want).groupBy("event_id", "step").agg(F.count(F.lit(1)), F.sum("pt_i"))
    key = lambda df: sorted((e, s, n, round(x, 9)) for e, s, n, x in df.collect())
    assert {s for _, s, *_ in key(few)} == set(steps) and key(few) == key(every)
    # both sides of the pairs read one exchange, and nothing else clusters
    assert clusterings(QUERIES["antikt_live_minor"](spark, "/root/testdata/sf0.001")) == 2
