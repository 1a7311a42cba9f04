"""Exact quantiles per group against sorting."""

import math
import random

from pyspark.sql import functions as F

from rfmlens.operators.profile import mean_vs_median
from rfmlens.operators.quantiles import exact_quantiles


def slow(rows, q):
    out = {}
    for g in {r[0] for r in rows}:
        for c in (1, 2):
            x = sorted(r[c] for r in rows if r[0] == g and r[c] is not None)
            out[g, c] = x[max(1, math.ceil(q * len(x))) - 1] if x else None
    return out


def test_against_sorting_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, rng.random(), 1.5, -0.0]), float(rng.randint(0, 3))) for _ in range(2000)]
    rows += [("one", 7.0, None), ("none", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    for ranges in (1, 9, 40):
        got = {r.g: r for r in exact_quantiles(df, ("x", "y"), "g", (0.0, 0.25, 0.5, 1.0), ("least", "low", "median", "most"), ranges).collect()}
        assert set(got) == {r[0] for r in rows}
        for name, q in (("least", 0.0), ("low", 0.25), ("median", 0.5), ("most", 1.0)):
            want = slow(rows, q)
            for (g, c), v in want.items():
                assert got[g][f"{name}_{'xxy'[c]}"] == v, (name, g, c)


def test_text_values_column_named_like_a_group_and_empty(spark):
    df = spark.createDataFrame([("a", "1", 5), ("a", "3.5", 6), ("a", "no", 7), ("b", None, 8)], "c string, v string, n int")
    got = {r.c: tuple(r)[1:] for r in exact_quantiles(df, ("v", "n"), "c").collect()}
    assert got == {"a": (1.0, 6.0), "b": (None, 8.0)}
    assert exact_quantiles(df.where("false"), ("v",), "c").count() == 0


def test_profile_median_is_exact_beyond_the_sketch(spark):
    df = spark.range(20_001).select((F.col("id") % 2).cast("int").alias("cluster"), (F.col("id") * 7919 % 20_001).cast("double").alias("avg_spend"))
    exact = {r.cluster: r.median_avg_spend for r in mean_vs_median(df, ("avg_spend",)).collect()}
    assert exact == {r.cluster: r.m for r in df.groupBy("cluster").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY avg_spend)").alias("m")).collect()}
    rough = {r.cluster: r.median_avg_spend for r in mean_vs_median(df, ("avg_spend",), accuracy=20).collect()}
    assert set(rough) == set(exact) and rough != exact
