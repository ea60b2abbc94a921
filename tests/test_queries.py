"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from partonframe.operators import cluster
from partonframe.plans.queries import ORACLES, QUERIES, flagship, particles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    sort = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert sort(got).equals(sort(want))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(spark, name):
    """Every particle is in one jet, and the jets' energies sum to the event's."""
    found = QUERIES[name](spark, SF).toPandas()
    own = particles(spark, SF).groupBy("event_id").agg({"energy": "sum", "idx": "count"}).toPandas().set_index("event_id").sort_index()
    assert not found.duplicated(["event_id", "idx"]).any()
    jets = found.drop_duplicates(["event_id", "jet"]).groupby("event_id").agg({"energy": "sum", "n": "sum"})
    assert (jets["n"] == own["count(idx)"]).all() and (jets["energy"] - own["sum(energy)"]).abs().max() < 0.1 and (found["n"] > 1).any()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_a_kernel_that_does_nothing_fails(spark, db, monkeypatch):
    name = "ca_jets"
    monkeypatch.setitem(cluster.KERNELS, "GeneralisedKT", lambda nodes, **_: nodes)
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLES[name]).df()
    assert len(got) == len(want) and sorted(got["n"]) != sorted(want["n"])


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_events_are_dealt_evenly(spark):
    """Few bytes that take long went to few tasks, of which the last ones ran alone."""
    dealt = particles(spark, SF, partitions=23)
    assert dealt.rdd.getNumPartitions() == 23
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, particles(spark, SF).collect()))
    plan = QUERIES["spectral_mean_jets"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning(event_id") == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_nested_jets_read_and_deal_the_particles_once(spark):
    """Five copies of the particles were joined, each of which read the tables and wrote them to shuffles."""
    plan = QUERIES["nested_jets"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning(event_id") == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
@pytest.mark.parametrize("name", ["decay_edge_first", "decay_edge_last"])
def test_decay_walks_read_and_deal_the_particles_once(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 1
