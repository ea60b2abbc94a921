"""The detector source on a stand-in file, and the assembly of its events."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan

from partonframe.operators import references
from partonframe.sources import detector

N = 40
OPENER = {"opener": "tests.detector_file:open_json", "entries": "10"}


@pytest.fixture
def path(tmp_path):
    rng = random.Random(1)
    sizes = [rng.randrange(5) for _ in range(N)]
    sizes[3] = 0
    floats = lambda: [[rng.uniform(-5, 5) for _ in range(n)] for n in sizes]
    tracks = [[rng.randrange(n) + 1 for _ in range(rng.randrange(4))] if n else [] for n in sizes]
    towers = [[[rng.randrange(n) + 1 for _ in range(rng.randrange(3))] for _ in range(rng.randrange(3))] if n else [] for n in sizes]
    branches = {
        "Particle.E": floats(), "Particle.Px": floats(), "Particle.Py": floats(), "Particle.Pz": floats(), "Particle.PT": floats(), "Particle.P": [[0.0] * n for n in sizes], "Particle.fBits": [[1] * n for n in sizes],
        "Particle.Rapidity": [[999.9 if i % 2 else -999.9 for i in range(n)] for n in sizes], "Event.Number": [100 + i for i in range(N)],
        "Track.Particle": tracks, "Track.P": [[1.0] * len(t) for t in tracks], "Tower.Particles": towers,
    }
    out = tmp_path / "events.json"
    out.write_text(json.dumps({"Delphes": branches}))
    return str(out)


def read_log(path):
    """{branch: sorted ranges of entries} since the last call."""
    found = {}
    with open(f"{path}.log", "a+") as f:
        f.seek(0)
        for key, a, b in map(str.split, f):
            found.setdefault(key, set()).add((int(a), int(b)))
    open(f"{path}.log", "w").close()
    return {k: sorted(v) for k, v in found.items()}


@pytest.fixture
def pushdown(spark):
    spark.conf.set(detector.PUSHDOWN, "true")
    yield
    spark.conf.unset(detector.PUSHDOWN)


def test_types_and_names_come_from_the_file(spark, path):
    events = detector.read_detector(spark, path, ["Particle", "Track", "Tower", "Event"], **OPENER)
    kinds = dict(events.dtypes)
    assert kinds["event_id"] == "bigint" and kinds["Energy"] == "array<double>" and kinds["Birr"] == "array<double>" and kinds["Track_Particle"] == "array<bigint>"
    assert kinds["Tower_Particles"] == "array<array<bigint>>" and kinds["Event_Number"] == "bigint" and "FBits" not in kinds and len(kinds) == 12
    assert set(read_log(path)["Particle.E"]) == {(0, 40)}  # a look for the types
    rows = events.orderBy("event_id").collect()
    want = json.load(open(path))["Delphes"]
    assert [r.Energy for r in rows] == want["Particle.E"] and [r.Tower_Particles for r in rows] == want["Tower.Particles"] and [r.event_id for r in rows] == list(range(N))


def test_only_the_branches_of_the_schema_are_read(spark, path):
    events = detector.read_detector(spark, path, "Particle", "event_id bigint, Px array<double>, Energy array<double>", **OPENER)
    assert events.count() == N
    assert read_log(path) == {k: [(0, 10), (10, 20), (20, 30), (30, 40)] for k in ("Particle.Px", "Particle.E")}


@pytest.mark.parametrize(("condition", "ranges", "ids"), [
    ("event_id = 17", [(17, 18)], [17]), ("event_id in (3, 8, 35)", [(3, 9), (35, 36)], [3, 8, 35]), ("event_id >= 28 and event_id < 32", [(28, 30), (30, 32)], [28, 29, 30, 31]),
    ("event_id > 38", [(39, 40)], [39]), ("event_id <= 0", [(0, 1)], [0]), ("event_id > 99", [], []), ("event_id = 5 and event_id = 6", [], []),
])
def test_filters_on_the_event_choose_entries(spark, path, pushdown, condition, ranges, ids):
    events = detector.read_detector(spark, path, "Particle", "event_id bigint, Px array<double>", **OPENER).where(condition)
    assert sorted(r.event_id for r in events.collect()) == ids
    assert (read_log(path) if ranges else {"Particle.Px": []}) == {"Particle.Px": ranges}
    if len(ids) == 1:  # the source has taken the comparison, so that Spark has only the null check left
        plan = events._jdf.queryExecution().executedPlan().toString()
        assert "Filter isnotnull(event_id" in plan and " AND " not in plan


def test_statistics_skip_ranges(spark, path, pushdown):
    schema = "event_id bigint, Number bigint"
    plain = detector.read_detector(spark, path, "Event", schema, **OPENER)
    statistics = detector.range_statistics(plain, ["Number"], 10)
    assert json.loads(statistics) == {"Number": [[0, 100, 109], [10, 110, 119], [20, 120, 129], [30, 130, 139]]}
    every = plain.collect()
    read_log(path)
    for condition, ranges in (("Number > 128", [(20, 30), (30, 40)]), ("Number = 110", [(10, 20)]), ("Number < 100", []), ("Number <= 100", [(0, 10)]), ("Number >= 139 and event_id < 35", [(30, 35)])):
        found = detector.read_detector(spark, path, "Event", schema, statistics=statistics, **OPENER).where(condition)
        holds = condition.replace(" = ", " == ")
        assert sorted(r.Number for r in found.collect()) == [r.Number for r in every if eval(holds, r.asDict())]
        assert read_log(path).get("Event.Number", []) == ranges


def test_what_a_reader_takes_and_leaves(path):
    reader = detector.FilteringReader({"path": path, "components": "Event", **OPENER, "statistics": '{"Number": [[0, 100, 109], [10, null, null], [20, 120, 129]]}'}, None)
    left = list(reader.pushFilters([EqualTo(("event_id",), 25), GreaterThanOrEqual(("Number",), 105), LessThan(("Other",), 3), IsNotNull(("event_id",)), In(("event_id",), (25, 3, 15))]))
    assert left == [GreaterThanOrEqual(("Number",), 105), LessThan(("Other",), 3), IsNotNull(("event_id",))]
    assert [(p.start, p.stop) for p in reader.partitions()] == [(25, 26)]
    reader = detector.FilteringReader({"path": path, "components": "Event", **OPENER, "statistics": '{"Number": [[0, 100, 109], [10, null, null], [20, 120, 129]]}'}, None)
    assert list(reader.pushFilters([LessThan(("Number",), 110)])) == [LessThan(("Number",), 110)]
    assert [(p.start, p.stop) for p in reader.partitions()] == [(0, 10), (30, 40)]  # the last range has no statistics


def test_choice_of_branches(spark, path):
    columns = lambda **more: set(detector.Branches({"path": path, "components": "Particle", **OPENER, **more}).columns())
    assert columns(keys="P[xy]") == {"Px", "Py"} and columns(keys="tests.detector_file:only_momenta") == {"Px", "Py", "Pz"} and "FBits" in columns(keys=".*")
    assert "Particle_Px" in columns(all_prefixed="true")
    assert {"Track_Particle", "Particle_Px"} <= set(detector.Branches({"path": path, "components": "Track, Particle", **OPENER, "all_prefixed": "true"}).columns())
    with pytest.raises(ValueError, match="components"):
        detector.Branches({"path": path, **OPENER})
    with pytest.raises(Exception, match="Nothing"):
        detector.read_detector(spark, path, "Particle", "event_id bigint, Nothing array<double>", **OPENER).collect()
    with pytest.raises(Exception, match="uproot"):
        detector.read_detector(spark, path, "Particle", "event_id bigint, Px array<double>").collect()


def test_assembled_events(spark, path):
    raw = json.load(open(path))["Delphes"]
    rows = detector.assembled(detector.read_detector(spark, path, ["Particle", "Track", "Tower"], **OPENER)).orderBy("event_id").collect()
    assert "Track_Birr" not in rows[0].asDict()
    for k, r in enumerate(rows):
        n = len(raw["Particle.E"][k])
        track, tower = [-1] * n, [-1] * n
        for i, ref in enumerate(raw["Track.Particle"][k]):
            track[ref - 1] = i
        for i, refs in enumerate(raw["Tower.Particles"][k]):
            for ref in refs:
                tower[ref - 1] = i
        assert (r.Particle_Track, r.Particle_Tower) == (track, tower)
        assert r.Tower_NTimeHits == [len(x) for x in raw["Tower.Particles"][k]] and r.Track_Particle == [x - 1 for x in raw["Track.Particle"][k]]
        assert r.Rapidity == [math.inf if i % 2 else -math.inf for i in range(n)]
        assert r.Birr == pytest.approx([math.hypot(a, b) for a, b in zip(raw["Particle.PT"][k], raw["Particle.Pz"][k], strict=True)])


def test_typed_pointers_of_any_depth(spark):
    tracks = spark.createDataFrame([(0, 0, 10), (0, 1, 11), (1, 0, 10)], "event_id long, idx long, uid long")
    towers = spark.createDataFrame([(0, 0, 20), (1, 0, 21), (1, 1, 22)], "event_id long, idx long, uid long")
    objects = references.objects({"track": tracks, "tower": towers})
    sources = spark.createDataFrame([(0, 0, [[10, 20], [], [99]]), (0, 1, [[20, 11, None]]), (1, 0, [[10, 20, 22]]), (1, 1, []), (1, 2, None)], "event_id long, idx long, refs array<array<long>>")
    resolved = references.resolve(sources, objects)
    assert sorted((r.event_id, r.idx, r.place, r.kind or "", r.target) for r in resolved.collect()) == [
        (0, 0, 0, "track", 0), (0, 0, 1, "tower", 0), (0, 0, 2, "", -1), (0, 1, 0, "tower", 0), (0, 1, 1, "track", 1), (0, 1, 2, "", -1), (1, 0, 0, "track", 0), (1, 0, 1, "", -1), (1, 0, 2, "tower", 1),
    ]
    listed = {(r.event_id, r.idx): (r.track, r.tower) for r in references.by_kind(sources, resolved, ["track", "tower"]).collect()}
    assert listed == {(0, 0): ([0, -1, -1], [-1, 0, -1]), (0, 1): ([-1, 1, -1], [0, -1, -1]), (1, 0): ([0, -1, -1], [-1, -1, 1]), (1, 1): ([], []), (1, 2): ([], [])}
    back = {(r.event_id, r.kind, r.idx): r.ref for r in references.back_pointers(resolved, objects).collect()}
    assert back == {(0, "track", 0): 0, (0, "track", 1): 1, (1, "track", 0): 0, (0, "tower", 0): 1, (1, "tower", 0): -1, (1, "tower", 1): 0}


def test_reflected_lists(spark):
    rows = spark.createDataFrame([([2, 0, 2, -1, 7], 3), ([], 2), ([1], 0), (None, 2)], "refs array<long>, n int")
    assert [r.x for r in rows.select(references.reflected(F.col("refs"), F.col("n"), deep=False).alias("x")).collect()][:3] == [[1, -1, 2], [-1, -1], []]
