"""Operators on small tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from partonframe.operators import cluster as cluster_module
from partonframe.operators import decay, integrity, jets, matching, pairwise, references
from partonframe.operators.cluster import cluster, cluster_batch, nodes, run_log
from partonframe.operators.kernels import genkt
from partonframe.plans.params import check_params, is_numeric_class, params_table, same_params, stored_params

RNG = np.random.default_rng(3)


def particles(spark, sizes):
    rows = []
    for event, n in enumerate(sizes):
        for i in range(n):
            p = RNG.uniform(-10, 10, 3)
            rows.append((event, i, *map(float, p), float(np.linalg.norm(p) + 1)))
    return spark.createDataFrame(rows, "event_id long, idx long, px double, py double, pz double, energy double")


def test_events_are_clustered_one_by_one(spark):
    p = particles(spark, [0, 1, 7, 12, 3]).cache()
    found = nodes(cluster(p, "GeneralisedKT", {"DeltaR": 0.7})).toPandas()
    for event, group in p.toPandas().groupby("event_id"):
        g = group.sort_values("idx")
        from tests.test_kernels import nodes as make

        root, ints, floats = genkt.cluster(make(g.px, g.py, g.pz, g.energy), 0.7).table()
        own = found[found.event_id == event].sort_values("label")
        assert own.jet_id.tolist() == root.tolist() and own.parent.tolist() == ints[:, 1].tolist()
        assert np.allclose(own.pt, floats[:, 0])


def test_large_and_failing_events_are_reported(spark):
    p = particles(spark, [2, 30])

    def broken(n, **params):
        if n.n == 2:
            raise np.linalg.LinAlgError
        return n

    log = {r.event_id: r for r in run_log(cluster(p, "Own", kernel=broken, most_particles=20), "Own").collect()}
    assert log[0].status == "linalg_error" and log[1].status == "too_large" and np.isnan(log[0].duration_s) and log[0].jet_name == "OwnJet"
    assert nodes(cluster(p, "Own", kernel=broken, most_particles=20)).count() == 0


def test_batches_resume(spark, tmp_path):
    p, path = particles(spark, [3] * 10).cache(), str(tmp_path / "nodes")
    assert not cluster_batch(p, path, "GeneralisedKT", batch_events=4)
    assert not cluster_batch(p, path, "GeneralisedKT", batch_events=4)
    assert cluster_batch(p, path, "GeneralisedKT", batch_events=4)
    assert spark.read.parquet(path).where("label = 0").count() == 10


@pytest.mark.parametrize("algorithm", ["Spectral", "SpectralMean", "CALE"])
def test_events_of_any_size_stay(spark, monkeypatch, algorithm):
    """Over 20,000 particles, events left the results of algorithms that need a matrix of all pairs."""
    monkeypatch.setitem(cluster_module.KERNELS, algorithm, lambda nodes, **_: nodes)
    n = 20_001
    large = spark.range(n).select(F.lit(0).cast("long").alias("event_id"), F.col("id").alias("idx"), *[F.lit(x).alias(c) for c, x in (("px", 1.0), ("py", 0.5), ("pz", 0.1), ("energy", 5.0))])
    assert nodes(cluster(large, algorithm)).count() == n


def test_a_name_keeps_its_parameters(spark, tmp_path):
    p, path = particles(spark, [3, 5, 2, 4]), str(tmp_path / "jets")
    assert not cluster_batch(p, path, "GeneralisedKT", {"DeltaR": 0.1}, batch_events=2)
    for other in ({"DeltaR": 9.0}, {"DeltaR": 0.1, "ExpofPTInput": 1.0}, None):
        with pytest.raises(ValueError, match="was clustered with"):
            cluster_batch(p, path, "GeneralisedKT", other)
    with pytest.raises(ValueError, match="was clustered with"):
        cluster_batch(p, path, "IterativeCone", {"DeltaR": 0.1}, name="GeneralisedKT")
    assert cluster_batch(p, path, "GeneralisedKT", {"DeltaR": 0.1 + 1e-12, "ExpofPTInput": 0})
    assert cluster_batch(p, path, "GeneralisedKT", {"DeltaR": 9.0}, name="Wide")


def test_names_of_the_wavelets(spark):
    p = particles(spark, [1, 6, 9])
    found = [sorted(map(str, nodes(cluster(p, name)).collect())) for name in ("Wavelet", "CALE", "CALECpp")]
    assert found[0] == found[1] == found[2] and found[0]


def test_unknown_parameters_are_refused(spark):
    for algorithm, params in (("Spectral", {"DeltaR": 1}), ("GeneralisedKT", {"DeltaR": -1}), ("GeneralisedKT", {"ExpofPTFormatInput": "real"}), ("Nothing", {})):
        with pytest.raises(ValueError):
            check_params(algorithm, params)
    assert check_params("Spectral", {"CutoffKNN": None})["CutoffKNN"] is None
    table = params_table(spark, "A", "GeneralisedKT", {"DeltaR": 0.4})
    assert stored_params(table, "A") == {"DeltaR": 0.4} and stored_params(table, "A", True)["PhyDistance"] == "angular"
    assert same_params({"a": 1.0, "b": None}, {"a": 1.0 + 1e-9, "b": None}) and not same_params({"a": 1}, {"a": 2})


def test_numeric_classes():
    nan, inf = float("nan"), float("inf")
    assert [is_numeric_class(x, "natural number") for x in (1, 0, 1.5, "1", None)] == [True, False, False, False, False]
    assert [is_numeric_class(x, "positive definite number") for x in (1, 0, inf, nan, "x")] == [True, False, True, False, False]
    assert [is_numeric_class(x, "real number") for x in (-1, nan, inf, "x", None)] == [True, True, True, False, False]


def test_trees(spark):
    found = nodes(cluster(particles(spark, [9]), "GeneralisedKT", {"DeltaR": 100.0})).cache()
    steps = jets.merge_sequence(found).toPandas()
    assert len(steps) == 8 and steps.label.tolist() == list(range(9, 17))
    below = jets.descendants(found, jets.roots(found).select("event_id", "label"))
    assert sorted(r.label for r in below.collect()) == list(range(9))
    whole = jets.descendants(found, jets.roots(found).select("event_id", "label"), last_only=False)
    assert sorted(r.label for r in whole.collect()) == list(range(16))
    back = jets.from_nested(jets.nested(found))
    columns = ["event_id", "jet_id", "label", "parent", "child1", "child2"]
    assert sorted(map(tuple, back.select(*columns).collect())) == sorted(map(tuple, found.select(*columns).collect()))


def test_given_groups(spark):
    p = particles(spark, [5]).withColumn("jet_id", F.when(F.col("idx") < 4, F.col("idx") % 2))
    made = jets.create_jets(p).toPandas().sort_values("label")
    assert made.label.tolist() == list(range(7)) and made.parent.tolist() == [5, 6, 5, 6, -1, -1, -1]
    assert made["size"].tolist()[5:] == [2, 2] and made.join_distance.isna().tolist()[5:] == [True, True]


def test_jet_selection(spark):
    table = spark.createDataFrame([(0, 1, 50.0, 3), (0, 2, 40.0, 1), (0, 3, 31.0, 2), (1, 1, 29.0, 5), (2, 1, 21.0, 2), (2, 2, 16.0, 2)], "event_id long, jet_id long, pt double, n_leaves int")
    kept = lambda *a, **b: sorted((r.event_id, r.jet_id) for r in jets.filter_jets(table, *a, **b).collect())
    assert kept() == [(0, 1), (0, 3)]
    assert kept(light=True) == [(0, 1), (0, 3), (1, 1), (2, 1), (2, 2)]
    assert kept(35, 1) == [(0, 1), (0, 2)]
    light = spark.createDataFrame([(0, 0, 25, 90.0)], "event_id long, idx long, mcpid int, generated_mass double")
    assert kept(light=light) == kept(light=True)


def test_nearest_and_laplacian(spark):
    p = spark.createDataFrame([(0, 0, 1.0, 3.0, 0.0), (0, 1, 1.0, 1.0, 0.0), (0, 2, 1.0, 2.5, 0.0)], "event_id long, idx long, pt double, rapidity double, phi double")
    pairs = pairwise.with_affinity(pairwise.with_distance2(pairwise.pairs(p, ordered=True)))
    edges = sorted((r.i, r.j) for r in pairwise.knn(pairs, 1).collect())
    assert edges == [(0, 2), (1, 2), (2, 0), (2, 1)]
    rows = {(r.i, r.j): r.value for r in pairwise.laplacian(pairs, p, "symmetric").collect()}
    a = np.exp(-np.subtract.outer([3, 1, 2.5], [3, 1, 2.5]) ** 2) * (1 - np.eye(3))
    d = 1 / np.sqrt(a.sum(0))
    want = d[:, None] * (np.diag(a.sum(0)) - a) * d
    assert all(abs(rows[i, j] - want[i, j]) < 1e-12 for i in range(3) for j in range(3))


def test_matching(spark):
    left = spark.createDataFrame([(0, 1, [1, 2], 0.5), (1, 1, [1, 2], 0.1), (2, 2, [3], 0.0), (3, 3, [1], 0.0)], "event_id long, Event_n long, c array<int>, x double")
    right = spark.createDataFrame([(0, 1, [1, 2], 0.12), (1, 1, [1, 2], 0.2), (2, 2, [4], 0.0), (3, 3, [1], 9.0)], "event_id long, Event_n long, c array<int>, x double")
    assert sorted((r.left_id, r.right_id) for r in matching.match_events(left, right).collect()) == [(0, 1), (1, 0), (2, -1), (3, 3)]


def test_decay_chains(spark):
    p = spark.createDataFrame([(0, i, pid) for i, pid in enumerate([5, 5, 5, 4, 5])], "event_id long, idx long, pid int")
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 1, 3), (0, 0, 4)], "event_id long, parent long, child long")
    start = p.where("idx = 1").select("event_id", "idx")
    ends = lambda first, s=start, e=edges: sorted(r.idx for r in decay.edge_instance(p, e, s, first).collect())
    assert ends(True) == [0] and ends(False) == [2]
    assert ends(False, p.where("idx = 0").select("event_id", "idx")) == [2, 4]
    assert ends(True, start.limit(0)) == []
    cycle = spark.createDataFrame([(0, 0, 1), (0, 1, 0)], "event_id long, parent long, child long")
    assert ends(True, start, cycle) == []
    # a long chain, a branch, and a way into a cycle
    n = 70
    many = spark.createDataFrame([(0, i, 5) for i in range(n + 6)], "event_id long, idx long, pid long")
    chain = [(0, i, i + 1) for i in range(n - 1)] + [(0, n - 1, n), (0, n - 1, n + 1), (0, n + 2, n + 3), (0, n + 3, n + 4), (0, n + 4, n + 3)]
    long = spark.createDataFrame(chain, "event_id long, parent long, child long")
    got = sorted((r.start, r.idx) for r in decay.edge_instance(many, long, many.select("event_id", "idx"), False).collect())
    assert got == sorted([(i, e) for i in range(n) for e in (n, n + 1)] + [(n, n), (n + 1, n + 1), (n + 5, n + 5)])
    lists = spark.createDataFrame([(0, [[1], [2], []])], "event_id long, Children array<array<int>>")
    assert sorted((r.parent, r.child) for r in decay.edges_from_lists(lists).collect()) == [(0, 1), (1, 2)]


def test_decay_chains_of_many_events(spark):
    """Against a walk from each start; with edges and ids given twice, null ids, indices and events, and cycles."""
    rng = np.random.default_rng(8)
    some = [(int(e), int(i), None if rng.random() < 0.05 else int(rng.integers(0, 2))) for e in range(-3, 30) for i in range(1, rng.integers(2, 25)) for _ in range(rng.integers(1, 3))]
    steps = [(int(e), int(rng.integers(0, 26)), int(rng.integers(0, 26))) for e in range(-3, 30) for _ in range(rng.integers(0, 30))]
    steps += steps[:20] + [(None, 1, 2), (1, None, 2), (1, 2, None)]
    begin = [(int(e), int(i)) for e in range(-3, 31) for i in range(0, 28, 3)] + [(1, None), (1, None), (None, 3), (None, None)]
    p, edges = spark.createDataFrame(some, "event_id long, idx long, pid int"), spark.createDataFrame(steps, "event_id long, parent long, child long")
    starts = spark.createDataFrame(begin, "event_id long, idx long")
    ids = {}
    for e, i, k in some:
        ids.setdefault((e, i), set()).update([] if k is None else [k])
    for first in (True, False):
        on = {}
        for e, a, b in steps:
            a, b = (b, a) if first else (a, b)
            if ids.get((e, a), set()) & ids.get((e, b), set()):
                on.setdefault((e, a), set()).add(b)
        want = set()
        for e, i in begin:
            seen, todo = set(), [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += on.get((e, x), ())
            want |= {(e, i, x) for x in seen if (e, x) not in on}
        found = decay.edge_instance(p, edges, starts, first)
        got = [tuple(r) for r in found.collect()]
        assert set(got) == want and len(got) == len(want)
    plan = decay.edge_instance(p, edges, starts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_integrity(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 2.0, 1.0, 0.0, 0.0, 0.5, 7)], "A_Px double, A_Py double, A_Pz double, A_Energy double, B_Px double, B_Py double, B_Pz double, B_Energy double, other int")
    assert integrity.tachyons(df) == ["B"] and integrity.drop_tachyons(df).columns == ["A_Px", "A_Py", "A_Pz", "A_Energy", "other"]
    with pytest.raises(ValueError):
        integrity.drop_tachyons(df, raise_error=True)
    tables = {"A_x": spark.range(3).withColumnRenamed("id", "event_id"), "B_x": spark.range(2).withColumnRenamed("id", "event_id"), "B_y": spark.range(3).withColumnRenamed("id", "event_id")}
    assert integrity.uneven(tables) == {"B_x": 2} and list(integrity.drop_uneven(tables)) == ["A_x"]
    assert integrity.phantom_columns(["other", "gone"], df) == ["gone"]


def test_references(spark):
    source = spark.createDataFrame([(0, 0, [1, 2]), (0, 1, [2, -1])], "event_id long, idx long, ref array<int>")
    target = spark.createDataFrame([(0, i) for i in range(4)], "event_id long, idx long")
    assert [r.ref for r in references.reflect_references(source, target).orderBy("idx").collect()] == [-1, 0, 1, -1]
    assert source.select(references.zero_based(F.col("ref"))).first()[0] == [0, 1]


def test_parity_and_assignment(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -1.0])], "vec_id long, embedding array<double>")
    two = one.withColumn("embedding", F.transform("embedding", lambda x, i: F.when(i == 1, -x).otherwise(x)))
    assert {r.dim: r.parity for r in references.parity(one, two).collect()} == {0: 1, 1: -1}
    centres = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 0.0])], "centre int, position array<double>")
    assert [r.centre for r in references.kmeans_assign(one, centres).orderBy("vec_id").collect()] == [0, 1]


def fragile(nodes, **_):
    """Clusters nothing, and fails on events of seven particles."""
    if nodes.n == 7:
        raise RuntimeError("event of seven")
    return nodes


def test_a_failed_call_has_saved_what_came_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    p = particles(spark, [1 + e % 3 for e in range(20)] + [7]).cache()
    good = cluster_module.KERNELS["GeneralisedKT"]
    monkeypatch.setitem(cluster_module.KERNELS, "GeneralisedKT", fragile)
    # the part of the large event decides how many saves come before it
    parts = 5
    last = p.where("event_id = 20").select(F.pmod(F.xxhash64("event_id"), F.lit(parts))).first()[0]
    with pytest.raises(Exception, match="event of seven"):
        cluster_batch(p, path, "GeneralisedKT", {"DeltaR": 0.5}, save_events=5)
    saved = {r[0] for r in spark.read.parquet(path).select("event_id").collect()} if last else set()
    before = {r[0] for r in p.where(F.pmod(F.xxhash64("event_id"), F.lit(parts)) < last).select("event_id").collect()}
    assert saved == before
    monkeypatch.setitem(cluster_module.KERNELS, "GeneralisedKT", good)
    assert cluster_batch(p, path, "GeneralisedKT", {"DeltaR": 0.5}, save_events=4)
    found = spark.read.parquet(path)
    assert found.select("event_id").distinct().count() == 21 and found.where("child1 = -1").count() == p.count()
    assert cluster_batch(p, path, "GeneralisedKT", {"DeltaR": 0.5}, batch_events=3, save_events=2)
    assert spark.read.parquet(path).count() == found.count()


def test_table_function_goes_on_after_events_that_fail(spark, monkeypatch):
    from partonframe.functions.udtf import ClusterEvents
    from partonframe.operators import cluster as C

    def fails(nodes, **_):
        raise np.linalg.LinAlgError if nodes.n == 3 else AssertionError

    monkeypatch.setitem(C.KERNELS, "Spectral", fails)
    monkeypatch.setattr("partonframe.functions.udtf.MOST_PARTICLES", 3)
    one = ClusterEvents()
    rows = [{"event_id": e, "px": 1.0 + i, "py": 0.5, "pz": 0.1, "energy": 5.0} for e, n in ((1, 3), (2, 9), (3, 3)) for i in range(n)]
    out = [x for row in rows for x in one.eval(row, "Spectral", "{}")] + list(one.terminate())
    assert [(x[0], x[1], x[-2]) for x in out] == [(1, None, "linalg_error"), (2, None, "too_large"), (3, None, "linalg_error")]
    assert all(len(x) == len(C.CLUSTERED) for x in out) and not one.rows


def batches_of(rows, size):
    columns = ["event_id", "idx", "px", "py", "pz", "energy"]
    return [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + size], strict=True)], columns) for a in range(0, len(rows), size)]


def taken(one, batches, algorithm, text="{}"):
    out = [x for b in batches for x in one.eval(b, pa.array([algorithm] * b.num_rows), pa.array([text] * b.num_rows))]
    return [r for b in [*out, *one.terminate()] for r in b.to_pylist()]


@pytest.mark.parametrize("algorithm", ["GeneralisedKT", "Spectral", "IterativeCone", "CALE"])
def test_table_function_takes_events_together(monkeypatch, algorithm):
    from partonframe.functions import udtf

    calls, kernel = [], cluster_module.KERNELS[algorithm]
    good = cluster_module.MANY[kernel]
    monkeypatch.setitem(cluster_module.MANY, kernel, lambda events, **how: calls.append(len(events)) or good(events, **how))
    monkeypatch.setattr(udtf, "ROWS", 60)
    rows = [(e, i, *p, float(np.linalg.norm(p) + 1)) for e, n in enumerate([3, 1, 40, 7, 2, 150, 9, 9, 5]) for i in range(n) for p in [RNG.uniform(-10, 10, 3).tolist()]]
    plain = udtf.ClusterEvents()
    want = [x for r in rows for x in plain.eval(dict(zip(["event_id", "idx", "px", "py", "pz", "energy"], r, strict=True)), algorithm, "{}")] + list(plain.terminate())
    for size in (11, 64, 1000):
        calls.clear()
        found = taken(udtf.ClusterTogether(), batches_of(rows, size), algorithm)
        assert sum(calls) == 8 and len(calls) <= 3, "the event of 150 goes alone"
        assert [tuple(r.values())[:7] for r in found] == [x[:7] for x in want] and {r["status"] for r in found} == {"ok"}
        assert np.allclose([[v for v in list(r.values())[7:16]] for r in found], [x[7:16] for x in want], equal_nan=True)


def test_table_function_takes_events_of_any_size(monkeypatch):
    from partonframe.functions import udtf

    monkeypatch.setitem(cluster_module.KERNELS, "SpectralMean", lambda nodes, **_: nodes)
    rows = [(1, i, 1.0, 0.5, 0.1, 5.0) for i in range(20_001)]
    assert len([r for r in taken(udtf.ClusterTogether(), batches_of(rows, 10_000), "SpectralMean") if r["status"] == "ok"]) == len(rows)
    one = udtf.ClusterEvents()
    out = [x for r in rows for x in one.eval(dict(zip(["event_id", "idx", "px", "py", "pz", "energy"], r, strict=True)), "SpectralMean", "{}")] + list(one.terminate())
    assert len(out) == len(rows) and {x[-2] for x in out} == {"ok"}


def test_table_function_holds_no_more_of_an_event_than_its_algorithm_takes(monkeypatch):
    from partonframe.functions import udtf

    monkeypatch.setattr(udtf, "MOST_PARTICLES", 3)
    rows = [(e, i, 1.0 + i, 0.5, 0.1, 9.0) for e, n in ((None, 2), (1, 3), (2, 40), (5, 1), (6, 4)) for i in range(n)]
    one, held = udtf.ClusterTogether(), []
    for b in batches_of(rows, 2):
        assert not list(one.eval(b, pa.array(["Spectral"] * 2), pa.array(["{}"] * 2)))
        held.append(sum(x.num_rows for x in one.open))
    found = [r for b in one.terminate() for r in b.to_pylist()]
    assert max(held) <= 5 and list(dict.fromkeys((r["event_id"], r["status"]) for r in found)) == [(None, "ok"), (1, "ok"), (2, "too_large"), (5, "ok"), (6, "too_large")]
    assert [(r["event_id"], r["label"]) for r in found if r["status"] != "ok"] == [(2, None), (6, None)]
    for wrong in (rows[5:7] + rows[2:5], rows[2:5] + rows[:2]):
        for size in (1, 5):
            with pytest.raises(ValueError, match="sorted by event_id"):
                taken(udtf.ClusterTogether(), batches_of(wrong, size), "GeneralisedKT")
    assert not taken(udtf.ClusterTogether(), [], "GeneralisedKT")


def test_table_functions_agree_in_sql(spark):
    from partonframe.functions import udtf
    from partonframe.plans import queries

    udtf.register(spark)
    p = particles(spark, [4, 1, 30, 130, 8] * 4).select(F.when(F.col("event_id") != 7, F.col("event_id")).cast("int").alias("event_id"), "idx", "px", "py", "pz", F.col("energy").cast("decimal(20, 12)").alias("energy"))
    p.cache().createOrReplaceTempView("some_particles")
    how = """'GeneralisedKT', '{"DeltaR": 0.7}'"""
    one = spark.sql(f"select * from cluster_events(table(some_particles) partition by event_id order by (idx), {how})").collect()
    together = spark.sql(f"select * from cluster_events_together(table(select * from some_particles distribute by event_id sort by event_id, idx), {how})").collect()
    by_event = spark.sql(f"select * from cluster_events_together(table(some_particles) partition by event_id order by (idx), {how})").collect()
    key = lambda r: (r.event_id if r.event_id is not None else -1, r.label)
    want = sorted(one, key=key)
    for found in (together, by_event):
        found = sorted(found, key=key)
        assert [r[:7] for r in found] == [r[:7] for r in want] and np.allclose([r[7:16] for r in found], [r[7:16] for r in want], equal_nan=True)
    # events that took their steps together share their time
    assert len({r.duration_s for r in together}) < len({r.event_id for r in together}) == len({r.duration_s for r in one}) == 20
    plan = queries.QUERIES["cluster_udtf"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "cluster_events_together" in plan


def test_kmeans_of_events_that_go_on_in_the_next_batch(spark):
    from partonframe.operators import kmeans
    from partonframe.operators.kernels import kmeans as kernel

    rng = np.random.default_rng(5)
    rows = [(e, i, *map(float, rng.normal(size=2))) for e, n in enumerate([30, 1, 7, 45, 2]) for i in range(n)]
    want = {(e, i): int(x) for e in range(5) for i, x in enumerate(kernel.fit(np.array([r[2:] for r in rows if r[0] == e]), min(3, sum(r[0] == e for r in rows)), patience=2)[0])}
    batches = list(kmeans._by_event((pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + 10], strict=True)], ["event_id", "idx", "x", "y"]) for a in range(0, len(rows), 10)), 2, lambda g: kernel.many(g, 3, patience=2), 8))
    assert {(r["event_id"], r["idx"]): r["cluster"] for b in batches for r in b.to_pylist()} == want and sum(b.num_rows for b in batches) == len(rows)
    found = kmeans.kmeans_by_event(spark.createDataFrame(rows, "event_id int, idx int, x double, y double"), 3, ["x", "y"], patience=2)
    assert {(r.event_id, r.idx): r.cluster for r in found.collect()} == want


def test_kmeans_goes_on_until_no_vector_is_nearer_to_another_mean(spark):
    from partonframe.operators import kmeans

    x = np.random.default_rng(8).normal(size=(1500, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")

    def misplaced(found):
        label = np.array([r.cluster for r in found.orderBy("vec_id").collect()])
        means = np.stack([x[label == c].mean(0) for c in range(7)])
        gaps = ((x[:, None] - means[None]) ** 2).sum(2)
        return int((gaps[np.arange(len(x)), label] > gaps.min(1) + 1e-9).sum())

    assert misplaced(kmeans.kmeans(rows, 7, max_iter=3, tolerance=0.0)) > 0
    assert misplaced(kmeans.kmeans(rows, 7, max_iter=3, tolerance=0.0, settle=True)) == 0
    # nearly all vectors are copies of one
    few = spark.createDataFrame([(i, [float(max(i - 95, 0)), 1.0]) for i in range(100)], "vec_id long, embedding array<double>")
    assert kmeans.kmeans(few, 5, settle=True).select("cluster").distinct().count() == 5
    assert kmeans.kmeans(few, 9, settle=True).select("cluster").distinct().count() == 5


@pytest.mark.parametrize("form, exponent", [("genkt", 1), ("genkt", -1), (None, 0)])
def test_no_pair_is_sent_for_the_first_step(spark, form, exponent):
    import io
    from contextlib import redirect_stdout

    rows = cluster_module.from_kinematics(particles(spark, [1, 2, 9, 30]))
    found = pairwise.first_choice(rows, 0.8, form, exponent)
    with redirect_stdout(io.StringIO()) as plan:
        found.explain()
    above = plan.getvalue().split("Join", 1)[0]
    assert "Window" in above and "Exchange" not in above
    assert found.count() == 4 and found.where("event_id = 0 and i = 0 and j = 0").count() == 1


@pytest.mark.parametrize("cells", [50, 400_000])
def test_nearest_of_particles_are_those_of_pairs(spark, monkeypatch, cells):
    from partonframe.operators import pairwise

    rng = np.random.default_rng(3)
    rows = [(e, 3 * i, float(y), float(phi), 1.0) for e, n in enumerate([1, 2, 9, 30, 9]) for i, (y, phi) in enumerate(zip(rng.integers(-3, 4, n) / 2, rng.integers(0, 62, n) * 0.1 - np.pi, strict=True))]
    rows += [(9, i, y, 7.0 * i, 1.0) for i, y in enumerate((0.5, float("nan"), 1.0, 0.0))]
    p = spark.createDataFrame(rows, "event_id long, idx long, rapidity double, phi double, pt double")
    want = pairwise.knn(pairwise.with_distance2(pairwise.pairs(p, ordered=True)), 3)
    monkeypatch.setattr(pairwise, "MOST_CELLS", cells)
    ordered = pa.Table.from_pylist([dict(zip(("event_id", "idx", "rapidity", "phi"), r, strict=False)) for r in rows])
    got = [tuple(r.values()) for b in pairwise._nearest(iter(ordered.to_batches(7)), 3, 20) for r in b.to_pylist()]
    assert sorted(got) == sorted(map(tuple, want.collect())) and sorted(map(tuple, pairwise.nearest(p, 3).collect())) == sorted(got)
