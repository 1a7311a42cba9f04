"""OP-14..22: features, repeatable k-means, silhouette, profiles, audiences."""

import random

from pyspark.sql import functions as F

from conftest import rows
from rfmlens.operators.audience import audience_all, audience_lists, audience_sizes
from rfmlens.operators.cluster import (assign_clusters, choose_k, prepare_features, scaled_columns,
                                       silhouette, silhouette_sweep)
from rfmlens.operators.profile import (band_distribution, category_shares, cluster_means,
                                       mean_vs_median)

FEATS = ("f1", "prediction", "f3")


def _wide(spark, n=400, seed=3):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        g = i % 3
        data.append(("d%04d" % i, str(g * 10 + rnd.random()), float(i % 5), g * 5.0 + rnd.random(), 1.0))
    data.append(("dbad", "not-a-number", 1.0, 2.0, 1.0))       # unparsable feature -> row dropped
    data.append(("dnull", None, 1.0, 2.0, 1.0))                # null feature -> row dropped
    return spark.createDataFrame(data, "ifa string, f1 string, prediction double, f3 double, const double")


def test_prepare_features_casts_drops_scales(spark):
    w = _wide(spark)
    prep = prepare_features(w, FEATS + ("const",))
    assert prep.count() == 400
    assert "age" in prep.columns and "prediction" not in prep.columns
    z = scaled_columns(prep, FEATS + ("const",), digits=None)
    # no centring: zero stays zero-sign, unit sample std; zero variance -> 0.0
    std = z.agg(F.stddev_samp("z_f3").alias("s"), F.max("z_const").alias("c")).first()
    assert abs(std.s - 1.0) < 1e-9 and std.c == 0.0


def test_kmeans_repeatable_under_any_layout(spark):
    prep = prepare_features(_wide(spark), FEATS).cache()
    outs = []
    for parts in (1, 3, 7):
        shuffled = prep.repartition(parts)
        lab = assign_clusters(shuffled, k=3, seed=11)
        outs.append(rows(lab, "ifa", "cluster"))
    assert outs[0] == outs[1] == outs[2]
    assert {c for _, c in outs[0]} == {0, 1, 2}
    # best of several seeds: same pick whether the seeds run concurrently or not
    from rfmlens.operators.cluster import fit_kmeans
    a = fit_kmeans(prep, 3, seed=11, n_init=3, parallel=3)
    b = fit_kmeans(prep, 3, seed=11, n_init=3, parallel=1)
    assert (a.seed, a.relabel) == (b.seed, b.relabel) and abs(a.cost - b.cost) <= 1e-9 * b.cost


def test_silhouette_closed_form_and_sweep(spark):
    prep = prepare_features(_wide(spark), FEATS)
    labelled = prep.withColumn("g", (F.col("f3") / 5).cast("int"))
    s = silhouette(labelled, prediction="g")
    # closed form from per-cluster n, sum and sum of squared norms
    pts = [(r.g, list(r.standardized)) for r in labelled.select("g", "standardized").collect()]
    stats = {}
    for g, x in pts:
        n, t, q = stats.get(g, (0, [0.0] * len(x), 0.0))
        stats[g] = (n + 1, [a + b for a, b in zip(t, x)], q + sum(v * v for v in x))
    total = 0.0
    for g, x in pts:
        nx = sum(v * v for v in x)
        d = {c: nx + q / n - 2 * sum(a * b for a, b in zip(x, t)) / n for c, (n, t, q) in stats.items()}
        n_own = stats[g][0]
        a = d[g] * n_own / (n_own - 1)
        b = min(v for c, v in d.items() if c != g)
        total += 1 - a / b if a < b else (b / a - 1 if a > b else 0.0)
    assert abs(s - total / len(pts)) < 1e-9
    sweep = silhouette_sweep(prep, ks=(2, 3, 4))
    assert [r.k for r in sweep.orderBy("k").collect()] == [2, 3, 4]
    assert choose_k(sweep, min_k=3) in (3, 4)


def _model(spark):
    data = [("d1", 0, 10.0, 100.0, 0.0, 2, 1, 3), ("d2", 0, 30.0, 50.0, 1.0, 4, 0, 4),
            ("d3", 1, 5.0, None, 3.0, 0, 0, 0), ("d4", 10, 7.0, 70.0, 9.0, 1, 1, 2),
            ("d5", 2, 8.0, 80.0, None, 5, 5, 10), ("d6", 2, 6.0, 60.0, 2.0, 1, 3, 4)]
    return spark.createDataFrame(
        data, "ifa string, cluster int, avg_spend double, device_price double, age double, "
              "a bigint, b bigint, overall_brq bigint")


def test_profiles(spark):
    m = _model(spark)
    means = cluster_means(m, ("avg_spend", "a", "b", "overall_brq"))
    got = {r.cluster: r for r in means.collect()}
    # clusters are ints: 10 sorts after 2
    assert [r.cluster for r in means.collect()] == [0, 1, 2, 10]
    assert got[0].avg_spend == 20.0 and got[0].ifa_count == 2 and got[1].ifa_count == 1
    shares = {r.cluster: r for r in category_shares(means, {"overall_brq": ("a", "b")}).collect()}
    for c, r in shares.items():
        if r.overall_brq:
            assert abs(r.a + r.b - 1.0) < 1e-12     # complete category set sums to 1
    assert shares[1].a is None                       # zero total -> null, not an error
    bands = {r.cluster: r for r in band_distribution(m).collect()}
    assert bands[0]["18-24"] == 1 and bands[0]["25-34"] == 1 and bands[0]["35-49"] is None
    assert bands[10]["18-24"] is None and bands[10].ifa_count == 1   # unmapped age 9.0
    assert bands[2]["35-49"] == 1 and bands[2].ifa_count == 2        # null age counted in size only
    med = {r.cluster: r for r in mean_vs_median(m, ("avg_spend",)).collect()}
    assert med[0].median_avg_spend == 10.0            # lower middle of an even count
    assert med[0].mean_avg_spend == 20.0 and med[0].mean_to_median_avg_spend == 2.0


def test_audiences(spark):
    m = _model(spark).union(_model(spark))
    lists = audience_lists(m)
    assert lists.count() == 6
    assert audience_all(m).count() == 6
    assert rows(audience_sizes(lists)) == [(0, 2), (1, 1), (10, 1), (2, 2)]


def test_load_clustered_csv_sorts_clusters_numerically(spark, tmp_path):
    from rfmlens.plans.profiling import load_clustered
    p = str(tmp_path / "clustered")
    spark.createDataFrame([("d1", "10", "5.0"), ("d2", "2", "7.5"), ("d3", "0", "1"), ("d4", "2", "x")],
                          "ifa string, prediction string, avg_spend string") \
        .coalesce(1).write.option("header", "true").csv(p)
    model = load_clustered(spark, p)
    means = cluster_means(model, ("avg_spend",)).collect()
    assert [r.cluster for r in means] == [0, 2, 10]          # not '0' < '10' < '2'
    assert {r.cluster: r.avg_spend for r in means} == {0: 1.0, 2: 7.5, 10: 5.0}   # 'x' -> null, ignored
