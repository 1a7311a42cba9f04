"""Stored tables of one bucketing: no exchange, hot keys apart, same rows as a join."""

import random

from conftest import rows

from rfmlens.operators.colocated import join_stored, store_by_key
from rfmlens.plans.inspect import exchanges


def tables(spark):
    rng = random.Random(2)
    big = [(rng.choice(["hot", f"d{rng.randint(0, 200)}", None]), i) for i in range(3000)]
    small = [(f"d{i}", i * 10) for i in range(0, 260, 2)] + [("hot", 7), (None, 8)]
    return spark.createDataFrame(big, "ifa string, v int"), spark.createDataFrame(small, "ifa string, w int")


def test_join_without_exchange(spark):
    big, small = tables(spark)
    a, b = store_by_key(big, "ifa", 6, "big", hot_share=20), store_by_key(small, "ifa", 6, "small", hot_share=20)
    assert [r.ifa for r in spark.read.parquet(a.hot_path).select("ifa").distinct().collect()] == ["hot"]
    assert spark.read.parquet(b.hot_path).count() == 0
    assert rows(a.rows(spark)) == rows(big)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        cold = spark.table(a.name).join(spark.table(b.name), "ifa")
        plan = cold._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert rows(join_stored(spark, a, b)) == rows(big.join(small, "ifa"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows(join_stored(spark, a, b)) == rows(big.join(small, "ifa"))
    assert exchanges(cold) == []


def test_hot_on_the_small_side_and_empty(spark):
    big, small = tables(spark)
    a, b = store_by_key(big, "ifa", 4, "big"), store_by_key(small.where("ifa in ('hot', 'd2')"), "ifa", 4, "small")
    assert rows(join_stored(spark, a, b)) == rows(big.join(small.where("ifa in ('hot', 'd2')"), "ifa"))
    c = store_by_key(big.where("false"), "ifa", 4, "none")
    assert join_stored(spark, c, b).count() == 0
