"""Language-model scores against a slow reimplementation, and normalisation."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rfmlens.llm import lm as L
from rfmlens.llm import lm_vectors as V


def tokens(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in re.split("[\x20\x09-\x0D]+", t) if w] + [None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def expected(docs, m):
    """Scores word by word: each class's words are looked up and summed anew for every token."""
    c = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    ids = {w.decode(): i for i, w in enumerate(m.words[:m.size])}
    rest, end = m.size, m.size + 1
    of = {}
    for w, i in ids.items():
        of.setdefault(int(m.kind[i]), []).append((i, c[w]))
    at = lambda w: end if w is None else ids.get(w, rest)
    out = []
    for i, t in docs:
        far = near = end
        base = score = known = 0
        for w in tokens(t):
            x = at(w)
            base += math.log10((c[w] + 1) / (n + v + 1))
            known += c[w] > 0
            score += m.table[m.kind[far] * m.classes + m.kind[near], m.kind[x]]
            if x < rest:
                weight = {j: k * math.exp(m.r[near] @ m.q[j, :-1] + m.q[j, -1]) for j, k in of[int(m.kind[x])]}
                score += math.log10(weight[x] / sum(weight.values()))
            elif x == rest:
                score += math.log10(c[w] * (1 - m.unseen) / m.rest) if c[w] else math.log10(m.unseen)
            far, near = near, x
        out.append((i, held(i), len(tokens(t)), known, n, base, score))
    return out


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n long, word string")


def run(spark, docs):
    rows = L.rows_of(frame(spark, docs), L.fold(F.col("doc_id"), 7) != 2, "doc_id", "text")
    m = L.learn(rows)
    return m, L.score(rows, m)


@pytest.mark.parametrize("frequent,vectors", [(L.FREQUENT, 4096), (L.FREQUENT, 50), (20, 4096)])
def test_against_brute_force(spark, monkeypatch, frequent, vectors):
    monkeypatch.setattr(L, "FREQUENT", frequent)  # 20: almost every word is joined
    monkeypatch.setattr(L, "PIECE", 7_000)
    monkeypatch.setattr(V, "VECTORS", vectors)
    monkeypatch.setattr(V, "ROUNDS", 4)
    rng = np.random.default_rng(1)
    vocab = [f"W{i}é" if i % 3 else f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choice(vocab, int(rng.integers(0, 120)), p=np.arange(400, 0, -1) / 80200))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " \n\t "), (None, "a B c  d"), (203, "w0 " * 30_000), (5, docs[5][1]), (5, docs[5][1])]
    m, df = run(spark, docs)
    want, got = sorted(expected(docs, m), key=str), sorted(map(tuple, df.collect()), key=str)
    key = lambda r: (str(r[:5]), round(r[5], 4))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_probabilities_add_up_to_one(spark, monkeypatch):
    """Over the end, all training types and the unseen type, after random pairs of words."""
    monkeypatch.setattr(V, "VECTORS", 300)
    rng = np.random.default_rng(7)
    docs = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 40) if x < 5000)) for i in range(300)]
    m, _ = run(spark, docs)
    assert m.size == 300 and m.rest > 0
    c = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    rare = np.array([n for w, n in c.items() if w is not None and w.encode() not in m.words[:m.size]])
    assert (10 ** m.within(rare)).sum() + m.unseen == pytest.approx(1, abs=1e-9)
    for far, near in rng.integers(0, m.size + 2, (50, 2)):
        x = np.array([[far, near, y] for y in range(m.size + 2)])
        p = [10 ** L.log_probs(z, m.size, m.kind, m.table, m.r, m.q, m.share, m.sums)[0] for z in x]
        assert sum(p) == pytest.approx(1, abs=1e-6)


def test_partitions_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(V, "ROUNDS", 6)
    rows = L.rows_of(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), L.fold(F.col("doc_id"), 7) != 2, "doc_id", "text")
    one, many = ({r.doc_id: r for r in L.score(x, L.learn(x)).collect()} for x in (rows.coalesce(1), rows.repartition(16)))
    assert set(one) == set(many)
    assert all(abs(a.score - many[d].score) <= 1e-6 * a.n_tokens for d, a in one.items())


def test_the_model_learns_contexts():
    rng = np.random.default_rng(0)
    t = rng.dirichlet(np.full(6, 0.2), 36)
    count = (rng.integers(1, 50, (36, 1)) * t * 1000).astype(int).reshape(6, 6, 6)
    flat = count.reshape(36, 6)
    ll = lambda lp: (flat * lp).sum() / flat.sum()
    p = flat.sum(axis=0) / flat.sum()
    assert ll(L.train_nce(count, steps=500)) > ll(np.log10(np.maximum(p, 1e-12))[None]) + 0.05


def test_held_out_beats_the_base(spark):
    sf = "/root/testdata/sf0.01"
    got = [r for r in L.op3_lm(spark, sf).collect()]
    out = [r for r in got if r.held_out]
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sum(r.score for r in out) > 0.92 * sum(r.base_score for r in out)


def test_extra_columns_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "one two", "x", 1.0, 3), (1, "one two", "y", 2.0, 4)], "doc_id long, text string, word string, model double, n long")
    got = L.score(r := L.rows_of(rows, F.lit(True), "doc_id", "text"), L.learn(r)).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].n_known == 3


def test_no_training_rows_and_empty_table(spark):
    i = next(i for i in range(50) if held(i))
    m, df = run(spark, [(i, "a b"), (i, None)])
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in df.collect()) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert run(spark, [(0, "a")])[1].where("false").count() == 0
    rows = L.rows_of(frame(spark, [(0, "a")]).where("false"), F.lit(True), "doc_id", "text")
    assert L.score(rows, L.learn(rows)).count() == 0
