"""Row numbers over ranges against ``row_number``."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from rfmlens.operators.order import global_row_number


def table(spark, n=500, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", None]) if rng.random() < 0.3 else "hot", rng.choice([None, 1.5, 2.0, float("nan"), -0.5])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, k string, v double")


def test_over_all_rows(spark):
    df = table(spark)
    want = {r.id: r.n for r in df.withColumn("n", F.row_number().over(Window.orderBy("v", F.desc("id")))).collect()}
    for ranges in (1, 7, 60):
        got = {r.id: r.n for r in global_row_number(df, ["v", F.desc("id")], out="n", ranges=ranges).collect()}
        assert got == want


def test_within_keys_and_nulls(spark):
    df = table(spark, seed=2)
    want = {r.id: r.n for r in df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")) - 1).collect()}
    got = {r.id: r.n for r in global_row_number(df, ["v", "id"], within=["k"], out="n", first=0, ranges=9).collect()}
    assert got == want


def test_empty_and_equal_rows(spark):
    df = table(spark)
    assert global_row_number(df.where("id < 0"), ["v"]).count() == 0
    assert global_row_number(df.where("id < 0"), ["v"], within=["k"]).count() == 0
    same = spark.createDataFrame([(1, "x")] * 50, "id long, k string")
    assert sorted(r.row_number for r in global_row_number(same, ["id"], within=["k"], ranges=4).collect()) == list(range(1, 51))


def test_no_single_partition(spark):
    from rfmlens.plans.inspect import has_single_partition
    assert not has_single_partition(global_row_number(table(spark), ["v", "id"]))
