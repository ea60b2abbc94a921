"""Column expressions against literal expectations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from partonframe.functions import angles, arrays, factors
from partonframe.functions import kinematics as K

INF, NAN = float("inf"), float("nan")


def values(spark, rows, names, column):
    return [r[0] for r in spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).select(column).collect()]


def same(got, want, tolerance=1e-9):
    return all((math.isnan(g) and math.isnan(w)) or g == w or abs(g - w) < tolerance for g, w in zip(got, want, strict=True))


def test_angles(spark):
    raw = [0.0, 1.0, math.pi, -math.pi, 3 * math.pi, 2 * math.pi, -0.5, 7.0, NAN]
    got = values(spark, [(x,) for x in raw], ["a"], angles.confine_angle("a"))
    assert same(got, [0, 1, -math.pi, -math.pi, -math.pi, 0, -0.5, 7 - 2 * math.pi, NAN])
    pairs = [(0.0, 1.0, 1.0), (-3.0, 3.0, 2 * math.pi - 6), (0.0, 2 * math.pi, 0.0), (math.pi, -math.pi, 0.0), (NAN, 1.0, NAN)]
    assert same(values(spark, [p[:2] for p in pairs], ["a", "b"], angles.angular_distance("a", "b")), [p[2] for p in pairs])


def test_rapidity(spark):
    cases = [(0.0, 0.0, 0.0, NAN), (0.0, 1.0, 1.0, INF), (0.0, -1.0, 1.0, -INF), (1.0, 0.0, 1.0, 0.0), (NAN, 1.0, 1.0, NAN), (1.0, 1.0, 2.0, 0.5 * math.log(3))]
    assert same(values(spark, [c[:3] for c in cases], ["pt", "pz", "e"], K.rapidity("pt", "pz", "e")), [c[3] for c in cases])


def test_pseudorapidity(spark):
    thetas = [0.0, math.pi / 4, math.pi / 2, 3 * math.pi / 4, math.pi]
    near = -math.log(math.tan(math.pi / 8))
    assert same(values(spark, [(t,) for t in thetas], ["t"], K.pseudorapidity("t")), [INF, near, 0.0, -near, -INF])


def test_mass_of_a_tachyon_is_nan(spark):
    assert same(values(spark, [(1.0, 2.0), (2.0, 0.0)], ["e", "p"], K.mass("e", "p", F.lit(0.0), F.lit(0.0))), [NAN, 2.0])


def test_add_all_finds_every_prefix(spark):
    df = spark.createDataFrame([(3.0, 4.0, 0.0, 6.0, 1.0, 0.0, 1.0, 2.0)], "Px double, Py double, Pz double, Energy double, A_Px double, A_Py double, A_Pz double, A_Energy double")
    row = K.add_all(df, with_mass=True).first()
    assert row["PT"] == 5 and row["A_PT"] == 1 and row["A_Theta"] == pytest.approx(math.pi / 4) and row["A_Rapidity"] == pytest.approx(0.5 * math.log(3)) and row["Mass"] == pytest.approx(math.sqrt(11))


def test_add_on_lists(spark):
    df = spark.createDataFrame([([3.0, 0.0], [4.0, 1.0])], "Px array<double>, Py array<double>")
    assert K.add_pt(df, depth=1).first()["PT"] == [5.0, 1.0]


def test_theta_prefers_the_momentum(spark):
    df = spark.createDataFrame([(2.0, 1.0, 9.0)], "Birr double, Pz double, PT double")
    assert K.add_theta(df).first()["Theta"] == pytest.approx(math.acos(0.5))


def test_factors(spark):
    row = [(2.0, 4.0)]
    assert values(spark, row, ["a", "b"], factors.genkt_factor(-1, "a", "b")) == [0.25]
    assert values(spark, row, ["a", "b"], factors.ratiokt_factor(1, "a", "b")) == [0.5]
    assert values(spark, row, ["a", "b"], factors.suppressedkt_factor(2, "a", "b")) == [0.5]
    assert values(spark, row, ["a", "b"], factors.singularity_factor(1, F.lit(0.25), "a", "b")) == [0.5]
    assert values(spark, row, ["a", "b"], factors.factor(None, 3, "a", "b")) == [1.0]
    assert factors.METRICS == {"antikt": -1.0, "cambridge_aachen": 0.0, "kt": 1.0}
    with pytest.raises(ValueError):
        factors.heat_kernel("a", "other")


def test_ragged(spark):
    df = spark.createDataFrame([([[1, 2], [3]], [[1, 2], [5]], [[1]])], "a array<array<int>>, b array<array<int>>, c array<array<int>>")
    assert arrays.depth(df, "a") == 2
    got = df.select(arrays.flatten(df, "a"), arrays.recursive_distance(F.col("a"), F.col("b"), 2), arrays.recursive_distance(F.col("a"), F.col("c"), 2), arrays.apply(F.col("a"), lambda x: x + 1, 2)).first()
    assert list(got) == [[1, 2, 3], 2.0, INF, [[2, 3], [4]]]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, -3.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(arrays.norm(a), arrays.embedding_distance2(a, b), arrays.embedding_root_angular2(a, b), arrays.embedding_root_angular2(a, a), arrays.embedding_norm(a)).first()
    assert np.allclose(got[:4], [5, 50, math.pi / 2, 0], atol=1e-7) and got[4] == [0.6, 0.8]


def test_soft_equality_and_truth(spark):
    assert values(spark, [(1.0, 1.0 + 1e-9), (NAN, NAN), (NAN, 1.0), (1.0, 2.0), (INF, INF)], ["a", "b"], arrays.soft_equal(F.col("a"), F.col("b"))) == [True, True, False, False, True]
    words = spark.createDataFrame([(w,) for w in ("None", "False", "no", "True", "else")], "w string")
    assert [r[0] for r in words.select(arrays.to_bool(F.col("w"))).collect()] == [None, False, False, True, True]
