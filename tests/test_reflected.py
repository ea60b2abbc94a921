"""Back-pointers within a row."""

import time

import pytest
from pyspark.sql import functions as F

from partonframe.operators import references


@pytest.mark.parametrize("refs, n", [([[2], [], [0, 2], [7, -1]], 5), ([[]], 3), ([[0]], 1), ([[1]], 0), ([[3], [3, 1]], 4)])
def test_gaps(spark, refs, n):
    want = [max([i for i, r in enumerate(refs) if k in r], default=-1) for k in range(n)]
    got = spark.createDataFrame([(refs, n)], "refs array<array<bigint>>, n int").select(references.reflected(F.col("refs"), F.col("n"), deep=True).alias("x")).first().x
    assert got == want


def test_the_work_grows_with_the_list(spark):
    n = 200_000
    began = time.time()
    long = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i * 7) % n).alias("refs"), F.lit(n).alias("n"))
    got = long.select(references.reflected(F.col("refs"), F.col("n"), deep=False).alias("x")).first().x
    assert sorted(got) == list(range(n)) and got[7] == 1 and time.time() - began < 60
