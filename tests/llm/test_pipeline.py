"""Every stage on its own input, against the operators' brute-force versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from rfmlens.llm import langid, neardup, pieces, quality
from tests.llm.test_decontam import brute as leaks_of
from tests.llm.test_neardup import brute as groups_of
from tests.llm.test_slow_scores import crc, slow_mixture, slow_ranking

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    extra = [(900_001, "", "en", "s", 0), (900_002, None, "en", "s", 0), (900_003, "12 34 $$", "de", "s", 8), (None, "The cat is on the mat by the of.", "en", "s", 9)]
    docs = docs.union(docs.where("doc_id in (3, 8)")).union(spark.createDataFrame(extra, docs.schema))
    out.append(docs)
    for name, f in C.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        f(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_keep_columns_and_whole_rows(stages):
    assert [n for n, _ in C.STAGES] == ["language", "quality", "near_duplicates", "decontamination", "pieces"]
    for a, b in zip(stages[:-2], stages[1:-1], strict=True):
        assert b.dtypes == a.dtypes and set(rows(b)) <= set(rows(a)) and 0 < b.count() <= a.count()


def test_language(spark, stages):
    m = langid.learn(stages[0], F.lit(True))
    lang, score, _ = m.predict([r.text for r in stages[0].collect()], 4.0)
    want = [tuple(r) for r, p, s in zip(stages[0].collect(), lang, score, strict=True) if p != "und" and s >= 0.5]
    assert rows(stages[1]) == sorted(want, key=str)
    assert not {900_001, 900_002, 900_003} & {r.doc_id for r in stages[1].collect()}


def test_quality(spark, stages):
    m = quality.learn(stages[1], spark.read.parquet(f"{SF}/labels.parquet"), quality.fold(F.col("doc_id"), 4) != 2)
    got = stages[1].collect()
    want = [tuple(r) for r, s in zip(got, m.score([r.text for r in got]), strict=True) if s >= 0.7]
    assert rows(stages[2]) == sorted(want, key=str)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in stages[2].collect()}
    assert np.mean([(r.doc_id in left) == labels[r.doc_id] for r in got if r.doc_id in labels]) > 0.95


def test_near_duplicates(stages):
    got = stages[2].collect()
    want, seen = [], set()
    found = groups_of([(r.doc_id, r.text) for r in got], 5)
    for r, (_, n, c, kept) in sorted(zip(got, found, strict=True), key=lambda x: str(x[0])):
        if n == 0 or c is None or kept and c not in seen:
            want.append(tuple(r))
            seen.add(c)
    assert rows(stages[3]) == sorted(want, key=str)
    assert len(got) > len(want)


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {x[0] for x in leaks_of([(r.doc_id, r.text) for r in stages[3].collect()], items)}
    assert bad and rows(stages[4]) == [r for r in rows(stages[3]) if r[0] not in bad]


def test_pieces(stages):
    spm = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_proto=pieces.model_bytes())
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    got = stages[5].collect()
    assert len(got) == len(texts) and all(r.ids == [1, *spm.encode(texts[r.doc_id]), 2] and r.n_tokens == len(r.ids) for r in got)


def test_run_against_slow_stages(spark, stages):
    """The whole of ``run`` against stages that share no code with the operators."""
    spm = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_proto=pieces.model_bytes())
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    told = slow_mixture([(d.lang, d.text) for d in docs])
    found = [(d, *told(d.text)) for d in docs]
    assert all(abs(s - 0.5) > 0.01 for _, _, s in found)
    docs = [d for d, lang, s in found if lang != "und" and s >= 0.5]
    texts = {d.doc_id: d.text for d in docs}
    labels = sorted({(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in texts and crc(r.doc_id, 4) != 2})
    score = slow_ranking(texts, labels)
    left = [(d.doc_id, d.text) for d in docs if score(d.text) >= 0.7]
    kept = {r[0] for r in groups_of(left, 5) if r[3]}
    left = [(i, t) for i, t in left if i in kept]
    bad = {x[0] for x in leaks_of(left, [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])}
    want = {i: [1, *spm.encode(t), 2] for i, t in left if i not in bad}
    got = C.run(spark, SF)
    assert got.columns == stages[-1].columns
    assert {r.doc_id: r.ids for r in got.collect()} == want and len(want) > 50


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, f in C.STAGES:
        docs = f(spark, docs, SF)
        assert docs.count() == 0


def test_one_of_each_group(spark):
    text = "a b c d e f g h i j k l"
    data = [(5, text, "x"), (5, text, "x"), (5, text + " m", "y"), (9, text, "z"), (None, text, "n"), (None, "p q r s t u v w x y", "n"), (None, "P q r s t u v w x y", "n"),
            (3, "", "e"), (3, "", "e"), (4, None, "e"), (8, "one", "o"), (7, "One", "o")]
    docs = spark.createDataFrame(data, "doc_id long, text string, version string")
    got = [tuple(r) for r in neardup.one_of_each(docs).collect()]
    assert sorted((r[0] is None, r[0] or 0) for r in got) == [(False, 3), (False, 3), (False, 4), (False, 5), (False, 7), (True, 0)]
    assert neardup.one_of_each(docs.where("false")).count() == 0
