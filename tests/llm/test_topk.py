"""Exact top-k against brute force."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rfmlens.llm import topk as T


def brute(rows, k, scale=1024):
    ok = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, seen = [], set()
    for q, a in ok:
        if q % 100 or (q, tuple(a)) in seen:
            continue
        seen.add((q, tuple(a)))
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]  # noqa: B905
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.choice([0, 0.5, -0.25, 0.001, 1], 6).tolist()) for i in range(330)]
    rows += [(400, None), (500, [1.0, None]), (600, [float("nan")] * 6), (None, [1.0] * 6), (700, [1.0, 1.0]), (800, []),
             (100, rows[100][1]), (7, rows[7][1]), (900, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    for block in (50, 4096):
        got = T.top_k(df, F.col("vec_id") % 100 == 0, 10, query_block=2, row_block=block)
        assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
        assert sorted(map(tuple, got.collect())) == brute(rows, 10)


def test_fewer_rows_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in T.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert T.top_k(df.where("false"), F.col("vec_id") == 0).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 6), st.integers(1, 30), st.integers(1, 4), st.integers(0, 99))
def test_selection(nq, nr, k, seed):
    rng = np.random.default_rng(seed)
    q, r = rng.integers(-2, 3, (nq, 4)), rng.integers(-2, 3, (nr, 4))
    scores = T.accumulate(q, r)
    assert (scores == q @ r.T).all()
    ids, own = rng.permutation(nr), rng.integers(0, nr, nq)
    a, b = T.select(scores, ids, own, k)
    for i in range(nq):
        want = sorted((-scores[i, j], ids[j]) for j in range(nr) if ids[j] != own[i])[:k]
        assert [(-scores[i, j], ids[j]) for j in b[a == i]] == want


def test_query_against_sql(spark):
    from tools.compare_oracle import compare
    assert compare(spark, "/root/testdata/sf0.001", ["op2_topk"]) == {"op2_topk": "ok"}
