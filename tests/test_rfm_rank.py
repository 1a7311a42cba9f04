"""OP-8, OP-10..12 goldens; EXT-1 equals percent_rank; no SinglePartition."""

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from rfmlens.plans.inspect import has_single_partition, plan_text
from rfmlens.operators.rank import RankSpec, percent_rank_window, percent_ranks, ranked_values
from rfmlens.operators.rfm import rfm_base, rfm_measures, rfm_scores, value_distribution

D = dt.date


def _daily(spark):
    anchor = D(2021, 4, 30)
    data = []
    # d001: first 2021-01-03, last 2021-04-19, 14 active days, usage 4482
    days = [D(2021, 1, 3)] + [D(2021, 2, i) for i in range(1, 13)] + [D(2021, 4, 19)]
    for i, d in enumerate(days):
        data.append(("d001", d, 4482 - 13 * 300 if i == 0 else 300))
    data.append(("d002", D(2021, 3, 8), 13))
    df = spark.createDataFrame(data, "ifa string, date date, sum_brq_daily bigint")
    return (df.withColumn("period_months", F.months_between(F.lit(D(2021, 4, 1)), F.trunc("date", "month")))
            .withColumn("days_since", F.datediff(F.lit(anchor), F.col("date"))))


def test_rfm_base_goldens(spark):
    base = {r.ifa: r for r in rfm_base(_daily(spark)).collect()}
    a = base["d001"]
    assert (a.first_seen, a.last_seen, a.min_period, a.max_period, a.duration_months) == (117, 11, 0.0, 3.0, 4.0)
    assert (a.data_usage_freq, a.brq_count) == (14, 4482)
    b = base["d002"]
    assert (b.first_seen, b.last_seen, b.duration_months) == (53, 53, 1.0)


def test_measures_goldens(spark):
    base = spark.createDataFrame(
        [("d1", 11, 14, 4482, 4.0), ("d2", 0, 17, 22888, 4.0), ("d3", 2, 16, 4848, 4.0)],
        "ifa string, last_seen int, data_usage_freq bigint, brq_count bigint, duration_months double")
    spend = spark.createDataFrame([("d1", 1768.52), ("d2", 838.74), ("d3", 768.8), ("d9", 5.0)],
                                  "ifa string, spend double")
    got = {r.ifa: (r.usage_frequency, r.brq_frequency, r.avg_spend) for r in rfm_measures(base, spend).collect()}
    assert got == {"d1": (3.5, 1120.5, 442.0), "d2": (4.25, 5722.0, 210.0), "d3": (4.0, 1212.0, 192.0)}


def _check_equal(df, col, desc, buckets):
    got = percent_ranks(df, [RankSpec(col, desc, "p")], buckets=buckets)
    exp = percent_rank_window(df, col, desc, "p")
    assert rows(got, "id", "p") == rows(exp, "id", "p")


def test_percent_rank_equals_window_with_ties_nulls_desc(spark):
    rnd = random.Random(7)
    data = []
    for i in range(3000):
        v = None if rnd.random() < 0.12 else float(rnd.choice(range(23)))
        w = None if rnd.random() < 0.1 else rnd.random() * 1000
        data.append((i, v, w))
    data.append((3000, float("nan"), float("nan")))
    df = spark.createDataFrame(data, "id int, few double, many double")
    for col in ("few", "many"):
        for desc in (False, True):
            for buckets in (1, 8, 64):
                _check_equal(df, col, desc, buckets)


def test_percent_rank_single_row_and_hot_value(spark):
    one = spark.createDataFrame([(1, 5.0)], "id int, v double")
    assert rows(percent_ranks(one, [("v", False, "p")]), "p") == [(0.0,)]
    # a third of all rows on one value
    data = [(i, 42.0 if i % 3 == 0 else float(i)) for i in range(900)]
    df = spark.createDataFrame(data, "id int, v double")
    _check_equal(df, "v", False, 16)
    _check_equal(df, "v", True, 16)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=40), st.booleans())
def test_percent_rank_property(spark, values, desc):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v int")
    _check_equal(df, "v", desc, 4)


def test_non_numeric_columns(spark):
    rnd = random.Random(11)
    base = dt.datetime(2021, 3, 14, 1, 0)
    data = [(i, base + dt.timedelta(minutes=rnd.randint(0, 300)), D(2021, 1, 1) + dt.timedelta(days=rnd.randint(0, 60)),
             rnd.choice(["", "a", "ab", "b", "ba", "zz", "é", "éa", None]))
            for i in range(600)]
    df = spark.createDataFrame(data, "id int, ts timestamp_ntz, d date, s string")
    for col in ("ts", "d", "s"):
        for desc in (False, True):
            _check_equal(df, col, desc, 8)


def _no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return old


def test_many_distinct_values_without_broadcast(spark):
    old = _no_broadcast(spark)
    try:
        rnd = random.Random(5)
        df = spark.createDataFrame([(i, None if i % 17 == 0 else rnd.randint(0, 400)) for i in range(2000)],
                                   "id int, v int")
        got = percent_ranks(df, [("v", True, "p"), ("v", False, "q")], buckets=8)
        assert "SinglePartition" not in plan_text(got)
        assert rows(got, "id", "p") == rows(percent_rank_window(df, "v", True, "p"), "id", "p")
        assert rows(got, "id", "q") == rows(percent_rank_window(df, "v", False, "q"), "id", "q")
        assert got.columns == ["id", "v", "p", "q"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hot_values_and_nulls_without_broadcast(spark):
    """A value (or null) holding a third of the rows is joined map-side."""
    old = _no_broadcast(spark)
    try:
        rnd = random.Random(9)
        data = [(i, 7.0 if i % 3 == 0 else (None if i % 29 == 0 else rnd.random() * 100)) for i in range(3000)]
        df = spark.createDataFrame(data, "id int, v double")
        for desc in (False, True):
            got = percent_ranks(df, [("v", desc, "p")], buckets=16)
            plan = plan_text(got, "simple")
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan and "__salt" in plan
            assert rows(got, "id", "p") == rows(percent_rank_window(df, "v", desc, "p"), "id", "p")
        # a third of the rows null: ranked like the window, or left unranked
        data = [(i, None if i % 3 == 0 else rnd.random() * 100) for i in range(3000)]
        df = spark.createDataFrame(data, "id int, v double")
        for desc in (False, True):
            got = percent_ranks(df, [("v", desc, "p")], buckets=16)
            assert rows(got, "id", "p") == rows(percent_rank_window(df, "v", desc, "p"), "id", "p")
            got = percent_ranks(df, [RankSpec("v", desc, "p", keep_nulls=False)], buckets=16)
            exp = percent_rank_window(df.where("v is not null"), "v", desc, "p")
            assert rows(got.where("v is not null"), "id", "p") == rows(exp, "id", "p")
            assert got.where("v is null").where("p is null").count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_signed_zeros_rank_as_one_value(spark):
    data = [(i, -0.0 if i < 5 else 0.0) for i in range(10)] + [(10 + i, float(v)) for i, v in enumerate(range(-10, 11)) if v]
    df = spark.createDataFrame(data, "id int, v double")
    for threshold in ("10485760b", "-1"):
        old = _no_broadcast(spark)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            for desc in (False, True):
                got = percent_ranks(df, [("v", desc, "p")], buckets=4)
                assert got.count() == 30
                assert rows(got, "id", "p") == rows(percent_rank_window(df, "v", desc, "p"), "id", "p")
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_text_with_a_long_common_prefix_is_spread(spark):
    df = spark.range(0, 5000).select(F.col("id"), F.format_string("device-%05d", F.col("id") % 4000).alias("v"))
    values, n = ranked_values(df, RankSpec("v", False, "p"), 8)
    assert n == 5000 and values.count() == 4000
    got = percent_ranks(df, [("v", False, "p")], buckets=8)
    assert rows(got, "id", "p") == rows(percent_rank_window(df, "v", False, "p"), "id", "p")


def test_no_single_partition_in_plan(spark):
    df = spark.range(0, 5000).select(F.col("id"), (F.col("id") % 97).cast("double").alias("v"))
    assert not has_single_partition(percent_ranks(df, [("v", True, "p")], buckets=8))
    assert has_single_partition(percent_rank_window(df, "v", True))


def test_scores_and_distributions(spark):
    data = [("d%03d" % i, i % 7, float(i % 5), float(i), i, float(i % 11), i) for i in range(60)]
    m = spark.createDataFrame(data, "ifa string, last_seen int, usage_frequency double, brq_frequency double, "
                                    "data_usage_freq bigint, avg_spend double, brq_count bigint")
    s = rfm_scores(m, 5.0, buckets=4)
    for p in ("r", "vf", "bf", "m"):
        bad = s.where((F.col(p) < 0) | (F.col(p) > 5) | (F.abs(F.col(p) - 5.0 * F.col(f"{p}_percentile")) > 1e-12))
        assert bad.count() == 0
    # most recent (smallest days-since) ranks last in descending order; its 9
    # tied rows share the lowest rank, so 51 rows sort before them
    top = s.orderBy("last_seen").first()
    assert top.r_percentile == 51 / 59 and top.r == 5.0 * 51 / 59
    # percentile of the second-lowest value with one row below = 1/(N-1)
    assert s.where("brq_frequency = 1.0").first().bf_percentile == 1 / 59
    assert s.select("ifa").distinct().count() == 60
    dist = value_distribution(m, "last_seen")
    assert sum(r.ifa_count for r in dist.collect()) == 60
    assert rows(value_distribution(m, "last_seen", unique_keys=True)) == rows(dist)
    assert [r.last_seen for r in dist.collect()] == sorted(r.last_seen for r in dist.collect())


def test_nulls_excluded_from_ranking(spark):
    rnd = random.Random(3)
    data = [(i, None if i % 9 == 0 else float(rnd.randint(0, 50))) for i in range(500)]
    df = spark.createDataFrame(data, "id int, v double")
    for desc in (False, True):
        got = percent_ranks(df, [RankSpec("v", desc, "p", keep_nulls=False)], buckets=8)
        exp = percent_rank_window(df.where("v is not null"), "v", desc, "p")
        assert rows(got.where("v is not null"), "id", "p") == rows(exp, "id", "p")
        assert got.where("v is null and p is not null").count() == 0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3), st.integers(-1000, 1000)), min_size=1, max_size=80),
       st.booleans(), st.booleans(), st.integers(1, 12))
def test_percent_rank_all_branches_property(spark, values, desc, keep_nulls, buckets):
    """Hot and other values against the single-partition window, with
    broadcasting off to reach the shuffle join."""
    old = _no_broadcast(spark)
    try:
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v int")
        got = percent_ranks(df, [RankSpec("v", desc, "p", keep_nulls)], buckets=buckets)
        if keep_nulls:
            assert rows(got, "id", "p") == rows(percent_rank_window(df, "v", desc, "p"), "id", "p")
        else:
            exp = percent_rank_window(df.where("v is not null"), "v", desc, "p")
            assert rows(got.where("v is not null"), "id", "p") == rows(exp, "id", "p")
            assert got.where("v is null and p is not null").count() == 0
        assert got.count() == len(values)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
