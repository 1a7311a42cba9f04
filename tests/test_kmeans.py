"""Fixed-point k-means: independent of the layout, equal to a slow version."""

import hashlib
import math
import random

import pytest

from rfmlens.config import ClusteringConfig
from rfmlens.operators import kmeans as K
from rfmlens.plans.clustering import cluster_table

FEATURES = ("x", "y")


def table(spark, n=240, seed=1):
    rng = random.Random(seed)
    rows = [(f"d{i}", 10 * (i % 3) + rng.random(), 5.0 * (i % 2) - rng.random(), "k") for i in range(n)]
    rows += [("null", None, 1.0, "k"), ("nan", float("nan"), 1.0, "k")]
    return spark.createDataFrame(rows, "ifa string, x double, y double, other string")


def slow_fit(points, starts, steps):
    centres = list(starts)
    d = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c))
    near = lambda p: min(range(len(centres)), key=lambda j: (d(p, centres[j]), j))
    for _ in range(steps):
        of = [near(p) for p in points]
        for j in range(len(centres)):
            own = [p for p, k in zip(points, of) if k == j]
            if own:
                centres[j] = tuple(sum(c) // len(own) for c in zip(*own))
    centres.sort()
    return centres, [near(p) for p in points]


def test_layout_does_not_matter(spark):
    told = []
    for parts in (1, 4, 200):
        p = K.points_of(table(spark).repartition(parts), FEATURES)
        f = K.fit(p, 5, seed=3)
        s = [tuple(r) for r in K.sweep(p, (2, 3, 5), seed=3).collect()]
        told.append((p.factors, f.centres, f.counts, f.cost, s, sorted(map(tuple, K.label(p, f).collect()))))
    assert told[0] == told[1] == told[2]


def test_against_slow_version(spark):
    p = K.points_of(table(spark), FEATURES)
    rows = p.rows.collect()
    points = [(r.z0, r.z1) for r in rows]
    seeds = []
    for turn in range(4):
        u = lambda k: (int(hashlib.md5(f"{k}:9:{turn}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32  # noqa: E731, B023
        w = [min((sum((a - b) ** 2 for a, b in zip(x, c)) for c in seeds), default=1) for x in points]
        i = min((i for i in range(len(rows)) if w[i] > 0), key=lambda i: (-math.log(u(rows[i].ifa)) / w[i], rows[i].ifa))  # noqa: B023
        seeds.append(points[i])
    assert K.start_centres(p, 4, seed=9) == seeds
    f = K.fit_from(p, {4: seeds, 2: seeds[:2]}, max_iter=3)
    for k in (2, 4):
        centres, of = slow_fit(points, seeds[:k], 3)
        assert f[k].centres == centres and f[k].counts == [of.count(j) for j in range(k)]
        assert f[k].cost == sum(sum((a - b) ** 2 for a, b in zip(x, centres[j])) for x, j in zip(points, of))


def test_silhouette_against_pairs(spark):
    p = K.points_of(table(spark, 60), FEATURES)
    f = K.fit(p, 3, seed=1)
    of = {r.ifa: r.cluster for r in K.label(p, f).collect()}
    rows = [(r.z0, r.z1, of[r.ifa]) for r in p.rows.collect()]
    d = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2
    total = 0.0
    for i, x in enumerate(rows):
        mean = lambda j: (lambda v: sum(v) / len(v))([d(x, y) for k, y in enumerate(rows) if k != i and y[2] == j])  # noqa: E731, B023
        a, b = mean(x[2]), min(mean(j) for j in {y[2] for y in rows} - {x[2]})
        total += (b - a) / max(a, b)
    assert K.silhouettes(p, {3: f})[3] == pytest.approx(total / len(rows), abs=1e-7)


def test_fits_end_when_nothing_moves_and_few_points(spark):
    p = K.points_of(table(spark), FEATURES)
    f = K.fit(p, 3, seed=2, max_iter=50)
    assert f.settled and f.steps < 50
    same = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0), ("c", 3.0, 2.0)], "ifa string, x double, y double")
    q = K.points_of(same, FEATURES)
    assert q.factors[1] == 0.0 and len(K.start_centres(q, 5)) == 2
    assert [r.k for r in K.sweep(q, (2, 3)).collect()] == [2]
    assert K.fit(K.points_of(same.where("false"), FEATURES), 2) is None


def test_clustering_job_keeps_rows_and_labels_them_alike(spark):
    cfg = ClusteringConfig(features=FEATURES, ks=(2, 3, 6), k=3, n_init=2)
    model, sweep = cluster_table(table(spark).repartition(7), cfg, sweep=True, min_k=3)
    again, _ = cluster_table(table(spark).repartition(90), cfg, sweep=True, min_k=3)
    assert model.columns == ["ifa", "other", "x", "y", "cluster"] and model.count() == 240
    assert [r.k for r in sweep.collect()] == [2, 3, 6]
    assert {(r.ifa, r.cluster) for r in model.collect()} == {(r.ifa, r.cluster) for r in again.collect()}


def test_steps_add_up_in_tasks_and_stay_exact(spark, monkeypatch):
    """A Lloyd step makes no row for each (point, fit); its sums are exact past 64 bits and at far offsets, ties go to the lower centre."""
    monkeypatch.setattr(K, "_labels", None)
    far, wide = 1 << 40, 2_900_000_000
    rows = [(i, far + (i % 2) * wide, -far) for i in range(40)]
    points = K.Points(spark.createDataFrame(rows, "ifa long, z0 long, z1 long").repartition(5), "ifa", FEATURES, (1.0, 1.0))
    at = {1: [(far, -far)], 2: [(far, -far), (far + 10, -far)], 3: [(far - 1, -far), (far + 1, -far), (far + wide, -far)]}
    got = K._sums(points, at)
    assert got[1, 0] == (40, [40 * far + 20 * wide, -40 * far], 20 * wide * wide)   # 1.7e20
    assert got[2, 0][0] == 20 and got[2, 1] == (20, [20 * (far + wide), -20 * far], 20 * (wide - 10) ** 2)
    assert got[3, 0] == (20, [20 * far, -20 * far], 20) and (3, 1) not in got and got[3, 2][2] == 0
    with pytest.raises(Exception, match="64 bits"):
        K._sums(points, {1: [(far - 2 * wide, -far)]})
    nothing = K.Points(points.rows.where("ifa < 0"), "ifa", FEATURES, (1.0, 1.0))
    assert K._sums(nothing, at) == {}
