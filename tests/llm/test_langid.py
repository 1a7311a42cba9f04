"""Mixture language identification: held-out accuracy, mixtures and edge cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from rfmlens.llm import langid as L

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_fold(spark):
    got = {r.doc_id: r for r in L.op6_langid(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    held = [d for d in docs if got[d.doc_id].held_out]
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) > 0.97


def model():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.full(64, 0.3), 3) + 1e-6
    return L.Languages(("aa", "bb", "cc"), p / p.sum(axis=1, keepdims=True))


def test_em_finds_the_shares():
    m = model()
    rng = np.random.default_rng(2)
    x = np.stack([rng.multinomial(4000, 0.7 * m.p[0] + 0.3 * m.p[2]), rng.multinomial(4000, m.p[1])])
    share = m.shares(x, 4.0)
    assert np.abs(share[0] - [0.7, 0, 0.3]).max() < 0.05 and share[0, 1] == 0
    assert share[1].tolist() == [0, 1, 0]


def test_choice_of_set_against_all_sets():
    from itertools import combinations
    m, rng = model(), np.random.default_rng(4)
    for mix in ([1, 0, 0], [0.5, 0.5, 0], [0.4, 0.3, 0.3]):
        x = rng.multinomial(3000, np.array(mix) @ m.p)[None]
        cost, best = 4 * np.log(3000), None
        for k in (1, 2, 3):
            for s in combinations(range(3), k):
                pi = m._em(x, np.array([[1 / k if j in s else 0 for j in range(3)]]))
                v = float(m._ll(x, pi)[0] - (k - 1) * cost)
                best = max(best or (-np.inf, None), (v, s))
        assert tuple(np.flatnonzero(m.shares(x, 4.0)[0])) == best[1]


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en", "u"), (2, "le chat et le chien", "fr", "u"), (3, None, "en", "u"), (4, "123 $$$", "en", "u"),
            (None, "the dog", None, "u"), (6, "", "fr", "u"), (7, "A", None, "u"), (8, "½ ² 12", "en", "u"), (9, "the " * 50_000, None, "u"), (9, "the " * 50_000, None, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    m = L.learn(docs, F.lit(True))
    assert m.names == ("en", "fr")
    got = L.identify(docs, m).collect()
    assert [r.language.lang for r in got] == ["en", "fr", "und", "und", "en", "und", got[6].language.lang, "und", "en", "en"]
    assert got[6].language.lang in ("en", "fr") and got[3].language.score == 0 and got[0].score == "u"
    nothing = L.learn(docs.where("false"), F.lit(True))
    assert nothing.names == () and {r.language.lang for r in L.identify(docs, nothing).collect()} == {"und"}
    assert L.identify(docs.where("false"), m).count() == 0


def test_a_document_settles_alone(spark):
    """Shares don't depend on the other documents of the block, nor stop at a number of rounds."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.full(60, 5.0), 4)
    model = L.Languages(("a", "b", "c", "d"), p)
    x = rng.multinomial(4000, p.mean(axis=0), 40) + rng.poisson(np.linspace(0, 9, 40))[:, None]
    start = np.full((40, 4), 0.25)
    together = model._em(x.astype(float), start)
    alone = np.vstack([model._em(x[i:i + 1].astype(float), start[i:i + 1]) for i in range(40)])
    assert np.abs(together - alone).max() < 1e-4
    once_more = together * ((x / (together @ p)) @ p.T) / x.sum(axis=1, keepdims=True)
    assert np.abs(once_more - together).max() < 1.1e-4
