"""Hot keys in row-level joins are joined map-side."""

from pyspark.sql import functions as F

from conftest import rows
from rfmlens.operators.skew import join_per_key
from rfmlens.plans.inspect import plan_text


def test_join_per_key_splits_hot_keys(spark):
    big = spark.createDataFrame([("hot" if i % 3 == 0 else ("k%d" % (i % 50) if i % 7 else None), i)
                                 for i in range(3000)], "k string, x int")
    small = spark.createDataFrame([("hot", 1.0)] + [("k%d" % j, float(j)) for j in range(0, 50, 2)],
                                  "k string, w double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold in (old, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            for share in (5, 1000):
                for how in ("inner", "left"):
                    got = join_per_key(big, small, "k", how, hot_share=share)
                    assert rows(got, "k", "x", "w") == rows(big.join(small, "k", how), "k", "x", "w")
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_every_hot_key_is_split(spark):
    """However many keys are hot, no task gets more than its share of one."""
    big = spark.range(0, 40_000).select((F.col("id") % 20).alias("k"), F.col("id").alias("x"))
    small = spark.range(0, 20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = join_per_key(big, small, "k")
        assert "BroadcastHashJoin" in plan_text(got, "simple")
        per_task = got.groupBy(F.spark_partition_id()).count().collect()
        assert len(per_task) > 1 and max(r["count"] for r in per_task) < 3 * 40_000 / len(per_task)
        assert got.where("w = 2 * k").count() == 40_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
