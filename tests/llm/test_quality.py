"""Bradley-Terry quality: held-out accuracy, fold rules and edge cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from rfmlens.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in Q.op5_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(got) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [r for r in labels if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.95


def test_held_out_labels_teach_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = Q.fold(F.col("doc_id"), 4) == 2
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.learn(docs, labels, ~held), Q.learn(docs, flipped, ~held)
    assert (a.weight == b.weight).all() and a.at == b.at


def test_order_of_pairs_and_threshold():
    rng = np.random.default_rng(1)
    width = len(Q.features(""))
    x = rng.normal(size=(200, width))
    good = x[:, 3] + 0.01 * x[:, 5] > -0.8
    m = Q.fit(x, good)
    s = ((x - m.mean) / m.scale) @ m.weight
    assert s[good].mean() > s[~good].mean() and m.weight.argmax() == 3
    assert abs((s < m.at).mean() - (~good).mean()) < 0.02


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "A good text.", "c"), (3, "x" * 200_000, "d"), (3, "x" * 200_000, "d")],
                                 "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (None, 0, 0), (99, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    one_class = Q.learn(docs, labels, F.lit(True))
    rows = Q.score_quality(docs, one_class).collect()
    assert len(rows) == 5 and all(abs(r.score - 0.7) < 1e-12 for r in rows) and rows[0].predicted == "a"
    both = Q.learn(docs, labels.withColumn("quality", F.when(F.col("doc_id") == 3, 0).otherwise(F.col("quality"))), F.lit(True))
    s = [r.score for r in Q.score_quality(docs, both).collect()]
    assert s[0] == s[1] > 0.7 > s[3] == s[4]
    assert Q.score_quality(docs.where("false"), both).count() == 0
    none = Q.learn(docs.where("false"), labels, F.lit(True))
    assert none.weight.any() == np.False_
