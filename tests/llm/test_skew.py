"""Joins and running totals with hot keys."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from partonframe.llm.scratch import BATCH_BYTES, Scratch, bound_batches
from partonframe.llm.skew import running_total, salted_join
from partonframe.shared import shared_dir


def test_hot_and_null_keys_join_once(spark):
    rng = random.Random(1)
    keys = [rng.choice(["hot", "hot", None, f"k{rng.randrange(500)}"]) for _ in range(6000)]
    many = spark.createDataFrame(list(enumerate(keys)), "i long, key string")
    n = Counter(keys)
    one = spark.createDataFrame([(k, n[k], f"v{k}") for k in n], "key string, n long, value string")
    got = salted_join(many, one, ["key"], "n", len(keys), F.col("i")).collect()
    assert sorted((r.i, r.value) for r in got) == [(i, f"v{k}") for i, k in enumerate(keys)]
    assert salted_join(many.limit(0), one, ["key"], "n", 0, F.col("i")).count() == 0


def test_running_totals_over_buckets(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", None]), rng.randrange(5), rng.randrange(100)) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, g string, b long, v long")
    got = {r.i: r.out for r in running_total(df, ["g"], "b", [F.col("i")], F.col("v"), "out").collect()}
    so_far = defaultdict(int)
    for i, g, b, v in sorted(rows, key=lambda r: (r[2], r[0])):
        assert got[i] == so_far[g]
        so_far[g] += v


def test_scratch_tables_can_be_dropped(spark):
    scratch = Scratch(spark)
    table = scratch.table(spark.range(5))
    assert table.count() == 5 and scratch.root.startswith(shared_dir(spark))
    scratch.drop(table)
    scratch.close()


def test_batches_are_bounded_and_tighter_bounds_kept(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    for now, then in (("64MB", str(BATCH_BYTES)), ("512k", "512k"), ("1000", "1000")):
        spark.conf.set(setting, now)
        bound_batches(spark)
        assert spark.conf.get(setting) == then
    spark.conf.set(setting, str(BATCH_BYTES))
