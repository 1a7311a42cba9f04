"""Language-model scoring: classes and vectors of words."""

import numpy as np
from pyspark.sql import functions as F

from rfmlens.llm import lm as L
from rfmlens.llm import lm_vectors as V


def test_classes_are_even_and_follow_contexts():
    rng = np.random.default_rng(1)
    kinds = np.repeat(np.arange(4), 64)
    shares = np.sqrt(np.eye(4)[kinds] * 0.8 + rng.dirichlet(np.ones(4), 256) * 0.2)
    got = V.classes_of(shares)
    assert set(np.bincount(got)) == {16}
    assert all(len(set(kinds[got == k])) == 1 for k in range(16))
    assert V.classes_of(np.zeros((0, 4))).tolist() == [] and V.classes_of(np.ones((1, 4))).tolist() == [0]


def test_gradients_against_differences():
    rng = np.random.default_rng(2)
    r, q = rng.normal(0, 0.5, (5, 3)), rng.normal(0, 0.5, (6, 4))
    a, b, n, noise = np.array([0, 4, 4]), np.array([1, 2, 5]), np.array([2.0, 1.0, 3.0]), rng.integers(0, 6, (3, 2))

    def gain(r, q):
        total = 0.0
        for i in range(3):
            f = lambda w, i=i: r[a[i]] @ q[w, :-1] + q[w, -1] - np.log(2)
            total += n[i] * (-np.log1p(np.exp(-f(b[i]))) - sum(np.log1p(np.exp(f(x))) for x in noise[i]))
        return total

    gr, gq = V.gradients(a, b, n, noise, r, q)
    whole = np.zeros_like(r)
    np.add.at(whole, a, gr)
    for x, g, of in ((r, whole, lambda y: gain(y, q)), (q, gq, lambda y: gain(r, y))):
        for i in np.ndindex(x.shape):
            y = x.copy()
            y[i] += 1e-6
            assert abs((of(y) - gain(r, q)) / 1e-6 - g[i]) < 1e-4


def test_order_of_words_in_one_class_counts(spark):
    """Pairs of words that go together score higher than the same words in other pairs."""
    rng = np.random.default_rng(2)
    common = [f"c{i}" for i in range(70)]
    texts = []
    for _ in range(3000):
        t = list(rng.choice(common, 12))
        i = int(rng.integers(0, 40))
        t[5:7] = [f"a{i}", f"b{i}"]
        texts.append(" ".join(t))
    rows = L.rows_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), L.fold(F.col("doc_id"), 7) != 2, "doc_id", "text")
    m = L.learn(rows)
    assert m.size == 150
    tries = [f"c1 c2 {a}{i} {b}{j} c3" for i in range(40) for a, b, j in (("a", "b", i), ("b", "a", i), ("a", "b", (i + 1) % 40))]
    given = L.rows_of(spark.createDataFrame(list(enumerate(tries)), "doc_id long, text string"), F.lit(False), "doc_id", "text")
    by = {r.doc_id: r.score for r in L.score(given, m).collect()}
    assert np.mean([by[k] > by[k + 1] for k in range(0, 120, 3)]) > 0.9
    assert np.mean([by[k] > by[k + 2] for k in range(0, 120, 3)]) > 0.75
