"""Event sets, text exchange, particle data, command line, streaming."""

import math
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from partonframe import cli
from partonframe.operators.kernels import genkt
from partonframe.plans.eventset import EventSet
from partonframe.sources import detector, external, parquet, particle_data
from partonframe.streaming.clustering import gather_events, windowed
from tests.test_kernels import event
from tests.test_operators import particles


def a_set(spark, n=10):
    df = spark.range(n).select(F.col("id").alias("event_id"), F.col("id").alias("A_x"), (F.col("id") * 1.0).alias("A_y"), F.sequence(F.lit(0), F.col("id").cast("int")).alias("B_z"))
    return EventSet(df, {"h": 1.0})


def test_names(spark):
    s = a_set(spark).add_alias("nick", "A_x")
    assert s.columns == ["nick", "A_x", "A_y", "B_z"] and s["h"] == 1.0 and s["nick"].count() == 10
    assert s.rename("A_x", "C").aliases == {"nick": "C"}
    assert s.rename_prefix("A_", "D_").columns == ["nick", "D_x", "D_y", "B_z"]
    assert s.remove("nick").columns == ["A_x", "A_y", "B_z"]
    assert s.remove_prefix("A_").columns == ["B_z"]
    assert s.append(Z=F.lit(1), Y=F.lit(2)).columns == ["nick", "A_x", "A_y", "B_z", "Y", "Z"]
    assert s.append_hyperparameters(g="x").hyper == {"h": 1.0, "g": "x"}
    for wrong in (lambda: s.remove("gone"), lambda: s.remove_prefix("gone"), lambda: s.add_alias("A_y", "A_x"), lambda: s.append(h=F.lit(1)), lambda: s.append_hyperparameters(A_x=1), lambda: s["gone"], lambda: s.rename("gone", "x")):
        with pytest.raises(KeyError):
            wrong()


def test_files(spark, tmp_path):
    s = a_set(spark).add_alias("nick", "A_x").save(str(tmp_path / "one"))
    again = EventSet.load(spark, str(tmp_path / "one"))
    assert again == s and again.columns == s.columns and again.hyper == {"h": 1.0} and again.df.count() == 10
    assert [x.path.rsplit("/", 1)[-1] for x in EventSet.find(spark, str(tmp_path))] == ["one"]


def test_a_set_is_saved_over_itself(spark, tmp_path):
    path = str(tmp_path / "sets" / "one")
    a_set(spark).save(path)
    for i in range(3):
        again = EventSet.load(spark, path)
        saved = again.append(**{f"C_{i}": F.col("A_x") + i}).append_hyperparameters(**{f"g{i}": i}).save()
        assert saved.df.count() == 10
    again = EventSet.load(spark, path)
    assert again.columns == ["A_x", "A_y", "B_z", "C_0", "C_1", "C_2"] and again.hyper == {"h": 1.0, "g0": 0, "g1": 1, "g2": 2}
    assert [r.C_2 for r in again.df.orderBy("event_id").collect()] == [i + 2 for i in range(10)]
    assert again.df.schema == saved.df.schema and [f.name for f in (tmp_path / "sets").iterdir() if f.is_dir()] == ["one"]
    # a write that fails leaves the old set as it is
    broken = again.append(bad=F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        broken.save()
    assert EventSet.load(spark, path).df.count() == 10 and [s.path.rsplit("/", 1)[-1] for s in EventSet.find(spark, str(tmp_path / "sets"))] == ["one"]


def test_shared_folders(spark):
    from partonframe import shared

    table = shared.written(spark.range(3))
    folder = table.inputFiles()[0].removeprefix("file:").lstrip("/").rsplit("/", 1)[0]
    assert table.count() == 3 and folder.startswith(shared.shared_dir(spark).removeprefix("file:").lstrip("/"))
    shared.sweep()
    assert not shared._made and not os.path.exists(f"/{folder}")

    class Cluster:
        master = "local-cluster[2,1,1024]"
        getConf = staticmethod(dict)

    class Session:
        sparkContext, conf = Cluster, {}

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session)


def test_parts(spark, tmp_path):
    s = a_set(spark)
    one, none, two = s.split([0, 4, 4], [4, 4, 10])
    assert none is None and (one.df.count(), two.df.count()) == (4, 6)
    with pytest.raises(ValueError):
        s.split([4], [3])
    assert [p.df.count() for p in s.pick([[1, 3], [2]])] == [2, 1]
    assert sorted(r.part for r in s.parts(n_fragments=3).collect()) == [0] * 3 + [1] * 3 + [2] * 4
    assert sorted(r.part for r in s.parts(fragment_length=4).collect()) == [0] * 4 + [1] * 4 + [2] * 2
    # by number, not by id
    far = EventSet(s.df.withColumn("event_id", F.col("event_id") ** 3 + 10**6).withColumn("event_id", F.col("event_id").cast("long")))
    assert [r.part for r in far.parts(n_fragments=5).orderBy("event_id").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert EventSet(s.df.limit(0)).parts(n_fragments=3).count() == 0
    done, rest = s.split_unfinished(spark.range(6).withColumnRenamed("id", "event_id"))
    assert (done.df.count(), rest.df.count()) == (6, 4) and s.split_unfinished(s.df)[1] is None
    joined = EventSet.combine([one.append(extra=F.lit(1)), two.append_hyperparameters(h=2.0)], averaged=lambda n: n == "h")
    assert joined.hyper["h"] == pytest.approx(1.6) and joined.df.where("extra is null").count() == 6
    with pytest.raises(ValueError):
        EventSet.combine([one, two.append_hyperparameters(h=2.0)])
    with pytest.raises(RuntimeError):
        EventSet.combine([])
    one.save(str(tmp_path / "in/a"))
    two.save(str(tmp_path / "in/deep/b"))
    assert EventSet.recursive_combine(spark, str(tmp_path / "in")).df.count() == 10


def test_long_and_wide(spark):
    s = spark.createDataFrame([(0, [1.0, 2.0], [3.0, 4.0])], "event_id long, x array<double>, y array<double>")
    long = parquet.to_long(s, ["x", "y"])
    assert sorted(map(tuple, long.collect())) == [(0, 0, 1.0, 3.0), (0, 1, 2.0, 4.0)]
    assert parquet.to_wide(long, ["x", "y"]).first() == s.first()


def test_external_text_round_trip(spark):
    found = genkt.cluster(event(4, 6), 100.0)
    _, ints, floats = found.table()
    params, back, numbers = external.parse_clusters(external.format_clusters(ints, floats, 100.0, "cambridge"))
    assert params == {"deltaR": 100.0, "algorithm": "cambridge", "ExpofPTInput": 0.0}
    assert back.tolist() == ints.tolist() and np.allclose(numbers, floats[:, :7])
    external.check_tree(back)
    back[0, 1] = 3
    with pytest.raises(ValueError):
        external.check_tree(back)


PROGRAM = """
import sys
rows = [list(map(float, l.split())) for l in sys.stdin if l.strip()]
print("# deltaR=1.0 kt id Label Parent Child1 Child2")
for r in rows: print(int(r[0]), int(r[0]), -1, -1, -1)
print("# PT Rapidity Phi Energy Px Py Pz")
for r in rows: print(0.0, 0.0, 0.0, r[4], r[1], r[2], r[3])
"""


def test_external_program(spark, tmp_path):
    (tmp_path / "p.py").write_text(PROGRAM)
    p = particles(spark, [2, 3])
    assert external.cluster_externally(p, [sys.executable, str(tmp_path / "p.py")]).count() == 5
    assert len(external.summary_lines(p).first()["value"].split()) == 5


def test_particle_data(spark):
    lines = spark.createDataFrame([('<particle id="5" name="b" antiName="bbar" spinType="2" chargeType="-1" m0="4.8"/>',), ('<particle id="25" name="h0" spinType="1" chargeType="0"/>',), ("text",)], "value string")
    table = particle_data.with_antiparticles(particle_data.parse_identities(lines))
    rows = {r.pid: r for r in table.collect()}
    assert rows[5].charge == pytest.approx(-1 / 3) and rows[-5].name == "bbar" and rows[-5].charge == pytest.approx(1 / 3) and rows[25].spin == 0 and rows[5].spin == 0.5
    pids = spark.createDataFrame([(x,) for x in (3, 5, -5, 5122)], "pid long")
    named = particle_data.names(pids, table).withColumn("m", particle_data.match(F.col("name"), "b")).withColumn("e", particle_data.match(F.col("name"), "b", False))
    assert {r.pid: (r.name, r.m, r.e) for r in named.collect()} == {3: ("3", False, False), 5: ("b", True, True), -5: ("bbar", True, False), 5122: ("5122", False, False)}


def test_branch_names():
    assert detector.branch_name("Particle.E", "P") == "P_Energy" and detector.branch_name("Track.fUniqueID") == "FUniqueID" and detector.branch_name("x.2d[3]") == "x2d3"
    assert detector.wanted_branch("Particle.PT") and not detector.wanted_branch("Particle.fBits")
    assert detector.unique_names(["a", "b", "a"]) == ["a", "b", "a2"]


def test_command_line(capsys):
    one = ["1", "1", "0", "0", "1", "0", "0"]
    cli.main(["GeneralisedKT", "{'DeltaR':", "0.5}", *one, *one])
    assert capsys.readouterr().out.strip() == "input_labels [ 0 1 ] cluster_sequence [ [ 0 1 2 ] ] remaining [ 2 ]"
    cli.main([])
    assert capsys.readouterr().out.strip() == "input_labels [ ] cluster_sequence [ ] remaining [ ]"


def test_stream_gathers_events(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{10 * e:02d}", e, i, 1.0, 2.0, 3.0, 9.0) for e in range(3) for i in (1, 0)] + [("2024-01-01 01:00:00", 99, 0, 1.0, 2.0, 3.0, 9.0)]
    schema = "ts string, event_id long, idx long, px double, py double, pz double, energy double"
    for k, part in enumerate((rows[:6], rows[6:])):
        spark.createDataFrame(part, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("ts timestamp, event_id long, idx long, px double, py double, pz double, energy double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = gather_events(stream).writeStream.format("memory").queryName("gathered").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.event_id: r.idx for r in spark.table("gathered").collect()}
    assert {0, 1, 2} <= set(got) and got[0] == [0.0, 1.0]


def _arriving(spark, folder, at, event, idx):
    rows = [(f"2024-01-01 00:{at}", event, i, 1.0, 2.0, 3.0, 9.0) for i in idx]
    df = spark.createDataFrame(rows, "ts string, event_id long, idx long, px double, py double, pz double, energy double")
    df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_late_particles_revise_an_event_also_after_a_restart(spark, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)

    def caught_up():
        stream = spark.readStream.schema("ts timestamp, event_id long, idx long, px double, py double, pz double, energy double").parquet(str(tmp_path / "in"))
        found = gather_events(stream, quiet_ms=5000, keep_ms=60_000)
        q = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start(str(tmp_path / "out"))
        q.processAllAvailable()
        q.stop()
        return sorted((r.event_id, r.revision, [int(i) for i in r.idx]) for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).where("event_id = 7").collect())

    try:
        steps = []
        for at, event, idx in [("00:00", 7, [2, 0]), ("00:30", 50, [0]), ("00:25", 7, [1]), ("01:00", 51, [0]), ("03:00", 52, [0]), ("02:55", 7, [3]), ("05:00", 53, [0])]:
            _arriving(spark, tmp_path / "in", at, event, idx)
            steps.append(caught_up())  # each time another query from the checkpoint
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    first, second, third = (7, 0, [0, 2]), (7, 1, [0, 1, 2]), (7, 0, [3])
    assert steps[0] == [] and steps[1] == steps[2] == [first]  # late, but not behind the watermark: waits until it is quiet again
    assert steps[3] == steps[4] == steps[5] == [first, second]
    assert steps[6] == sorted([first, second, third])  # no longer kept, so it begins anew


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 00:00:09", "a", 2.0), ("2024-01-01 00:00:11", "b", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.event_type, r.n, r.total) for r in windowed(df, "10 seconds").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
    assert math.isclose(sum(r.n for r in windowed(df, "10 seconds", "5 seconds").collect()), 6)


def test_answers_of_node_tables(spark):
    from partonframe.operators.cluster import cluster, nodes
    from partonframe.schema import NODE_INTS

    found = nodes(cluster(particles(spark, [5]), "GeneralisedKT", {"DeltaR": 100.0}))
    lines = [r.value for r in external.answer_lines(found, 100.0, "cambridge").orderBy("place").collect()]
    _, ints, floats = external.parse_clusters(lines)
    want = np.array([list(r) for r in found.orderBy("label").select(*NODE_INTS).collect()])
    assert ints.tolist() == want.tolist() and floats.shape == (9, 7)
    drawn = external.draw_tree(want).split("\n")
    assert drawn[0] == "8" and sorted(int(x) for x in drawn) == list(range(9))
