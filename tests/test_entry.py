"""Driver contract: entry, queries and oracle SQL agree on sf0.001."""

import os

import pytest

import __spark_entry__ as E
from rfmlens.plans import oracle, registry

SMOKE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE), reason="test tables not present")

ROWS_ONLY = {"silhouette_sweep", "assign_clusters", "kmeans_profile"}


def test_entry_schema(spark):
    df = E.entry(spark)
    assert df.columns[:7] == ["ifa", "last_seen", "usage_frequency", "brq_frequency",
                              "data_usage_freq", "avg_spend", "brq_count"]
    assert df.count() > 0


def test_every_query_has_oracle_or_is_rows_only():
    q, o = registry.queries(), oracle.oracle_sql()
    assert set(q) - set(o) == ROWS_ONLY
    assert set(o) <= set(q)
    assert set(q) <= set(E.queries()) and set(o) <= set(E.oracle_sql())


def test_queries_match_oracle_smoke(spark):
    from tools.compare_oracle import compare
    names = [n for n in registry.queries() if n not in ROWS_ONLY]
    res = compare(spark, SMOKE, names)
    assert all(v == "ok" for v in res.values()), res


def test_registered_plans_scale_properties(spark):
    """No registered query plans a global single-partition exchange, and the
    raw scans read only the columns they use."""
    from rfmlens.plans.inspect import has_single_partition, read_schemas
    q = E.queries()
    for name in ("daily_usage", "usage_histogram", "monthly_spend", "rfm_measures", "rfm_scores",
                 "percent_rank_scaled", "cluster_means", "band_distribution", "mean_vs_median"):
        df = q[name](spark, SMOKE)
        assert not has_single_partition(df), name
        for schema in read_schemas(df):
            if "l_orderkey" in schema:         # lineitem has 11 columns
                assert schema.count(":") <= 4, (name, schema)
    # usage is never shuffled by app: the category's bundle list is broadcast
    from rfmlens.plans.inspect import exchanges
    for name in ("category_usage", "monthly_spend", "rfm_measures"):
        assert not any("bundle" in e for e in exchanges(q[name](spark, SMOKE))), name


def test_rows_only_queries_smoke(spark):
    """The k-means queries (no SQL form) run and keep their invariants."""
    q = E.queries()
    sweep = q["silhouette_sweep"](spark, SMOKE).orderBy("k").collect()
    assert [r.k for r in sweep] == list(range(2, 10))
    assert all(-1.0 <= r.silhouette <= 1.0 for r in sweep)
    labelled = q["assign_clusters"](spark, SMOKE)
    n = labelled.count()
    assert n > 0 and labelled.select("ifa").distinct().count() == n
    assert {r.cluster for r in labelled.select("cluster").distinct().collect()} <= set(range(6))
    prof = q["kmeans_profile"](spark, SMOKE).collect()
    assert sum(r.ifa_count for r in prof) == n
