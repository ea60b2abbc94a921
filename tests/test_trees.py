"""Places of nodes in trees of any depth."""

import random

import pyarrow as pa

from partonframe.operators import jets
from partonframe.operators.cluster import cluster, nodes
from tests.test_operators import particles

SCHEMA = "event_id long, label long, parent long, child1 long"


def table(spark, edges):
    """A node table of {event: {label: parent}}."""
    rows = [(e, x, p, -1 if x not in set(tree.values()) else min(k for k, v in tree.items() if v == x)) for e, tree in edges.items() for x, p in tree.items()]
    return spark.createDataFrame(rows, SCHEMA)


def below(tree, start):
    out, todo = set(), [start]
    while todo:
        at = todo.pop()
        more = [x for x, p in tree.items() if p == at]
        out |= set(more)
        todo += more
    return out


def test_descendants_of_random_trees(spark):
    rng = random.Random(1)
    edges = {e: {x: rng.randrange(-1, x) if x else -1 for x in range(n)} for e, n in enumerate((1, 2, 9, 40))}
    every = table(spark, edges)
    got, leaves = {}, {}
    for last_only, out in ((False, got), (True, leaves)):
        for r in jets.descendants(every, every.select("event_id", "label"), last_only).collect():
            out.setdefault((r.event_id, r.start), set()).add(r.label)
    for e, tree in edges.items():
        ends = set(tree) - set(tree.values())
        for x in tree:
            assert got.get((e, x), set()) == below(tree, x)
            assert leaves[e, x] == (below(tree, x) | {x}) & ends
    counts = {(r.event_id, r.label): r.n_leaves for r in jets.leaf_counts(every).collect()}
    assert counts == {k: len(v) for k, v in leaves.items()}


def test_a_chain_of_twenty_thousand_nodes(spark):
    n = 20_000
    chain = spark.range(n).selectExpr("0L event_id", "id label", "id - 1 parent", f"case when id = {n - 1} then -1L else id + 1 end child1")
    start = spark.createDataFrame([(0, 0), (0, n // 2), (0, n - 1), (0, n - 1), (5, 0)], "event_id long, label long")
    counts = {r.start: r["count"] for r in jets.descendants(chain, start, last_only=False).groupBy("start").count().collect()}
    assert counts == {0: n - 1, n // 2: n - 1 - n // 2}
    assert {(r.start, r.label) for r in jets.descendants(chain, start).collect()} == {(0, n - 1), (n // 2, n - 1), (n - 1, n - 1)}
    assert jets.leaf_counts(chain).groupBy("n_leaves").count().collect() == [(1, n)]


def test_cycles_and_lost_parents_have_no_places(spark):
    rows = [(0, 0, -1, 1), (0, 1, 0, -1), (0, 2, 3, 3), (0, 3, 2, 2), (0, 4, 99, -1)]
    places = {r.label: (r.enter, r["last"]) for r in jets.interval_labels(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert places == {0: (0, 1), 1: (1, 1), 2: (None, None), 3: (None, None), 4: (None, None)}
    found = jets.descendants(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows, SCHEMA).select("event_id", "label"), False)
    assert [tuple(r) for r in found.collect()] == [(0, 0, 1)]


def test_jets_of_groups_and_of_clusters(spark):
    p = particles(spark, [6, 4])
    for found in (jets.create_jets(p.selectExpr("*", "idx % 2 as jet_id")), nodes(cluster(p, "GeneralisedKT", {"DeltaR": 1.0}))):
        counts = jets.leaf_counts(found)
        want = jets.jets(found).selectExpr("event_id", "jet_id as label", "n_leaves")
        assert sorted(map(tuple, want.collect())) == sorted(map(tuple, counts.join(want.select("event_id", "label"), ["event_id", "label"]).collect()))


def test_events_are_numbered_together_whatever_batches_they_come_in():
    rng = random.Random(2)
    rows = [(e, x, rng.randrange(-1, x) if x else -1) for e, n in enumerate((3, 1, 40, 200, 7, 2)) for x in range(n)]
    event, label, parent = map(pa.array, zip(*rows, strict=True))
    inner = {(e, p) for e, _, p in rows}
    table = pa.table({"event_id": event, "label": label, "parent": parent, "leaf": [(e, x) not in inner for e, x, _ in rows]})
    want = jets._places(table).to_pylist()
    for size, held in ((7, 10), (7, 1), (50, 100), (1000, 1)):
        got = list(jets._numbered(iter(table.to_batches(size)), held))
        assert [r for b in got for r in b.to_pylist()] == want
        assert all(b["event_id"][0] != a["event_id"][-1] for a, b in zip(got[:-1], got[1:], strict=True))
    for r in want:
        under = [x for x in want if x["event_id"] == r["event_id"] and r["enter"] <= x["enter"] <= r["last"]]
        tree = {x: p for e, x, p in rows if e == r["event_id"]}
        assert {x["label"] for x in under} == below(tree, r["label"]) | {r["label"]} and r["n_leaves"] == sum(x["leaf"] for x in under)
