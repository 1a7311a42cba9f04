"""Quality classifier: Bradley-Terry ranking of documents.

A document's strength is a linear function of features of its text. Every pair of a good and a bad training
document is a won comparison; the weights minimise the logistic loss of the pairs' feature differences. The
threshold is a quantile of the training documents' strengths: the share of bad ones, unless given. The score
is the logistic function of the strength, shifted so that the threshold scores ``CUT``.

Learning uses at most ``sample`` labelled rows (those with the smallest hash of the id, of both labels alike) and ``pairs``
comparisons drawn from them with a fixed seed; scoring covers all rows and whole texts.

Cases: null texts count as empty and are scored like any other; labels that are null or have no document
teach nothing; repeated labels count once; without both labels every document scores ``CUT``; null ids count as
held out only if crc32 of the empty string says so; other columns are kept by ``score_quality`` and ignored by the query.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rfmlens.llm.langid import fold

CUT = 0.7
KINDS = np.zeros(256, np.int64)  # 0 lower case and beyond ASCII, then: upper, digit, space, line feed, stop, symbol
KINDS[65:91], KINDS[48:58], KINDS[[9, 11, 12, 13, 32]], KINDS[10] = 1, 2, 3, 4
KINDS[[ord(c) for c in ".,;:?'\"-()"]] = 5
KINDS[[c for c in range(33, 127) if KINDS[c] == 0 and not 97 <= c <= 122]] = 6
ENDS = tuple(bytes([c]) for c in np.flatnonzero(KINDS == 6))


def features(text: str | None) -> list[float]:
    """Features of one text; neither its length in words nor any label, language or source is among them."""
    b = (text or "").encode("utf-8", "replace")
    kinds = np.bincount(KINDS[np.frombuffer(b, np.uint8)], minlength=7) / max(1, len(b))
    words = b.lower().split()
    n = max(1, len(words))
    count = Counter(words)
    top = [c for _, c in count.most_common(3)]
    pairs = len(set(zip(words, words[1:])))  # noqa: B905
    lines = [x for x in b.split(b"\n") if x.strip()]
    runs = sum(x == y for x, y in zip(words, words[1:]))  # noqa: B905
    odd = sum(map(lambda w: w.endswith(ENDS), words)) / n
    size = sum(map(len, words)) / n
    raw = [*kinds[1:].tolist(), len(count) / n, top[0] / n if top else 0, sum(top) / n, pairs / n, runs / n,
           len(set(lines)) / max(1, len(lines)), odd, sum(len(w) <= 3 for w in words) / n, size / 10, np.log1p(size)]
    return [*raw, *np.log(np.array([kinds[1], kinds[6], kinds[5], odd, runs / n, 1 - len(count) / n, 1 - pairs / n]) + 0.01).tolist(),
            1.0 if not words else 0.0]


@dataclass(frozen=True)
class Ranking:
    """Strength of x: ((x - mean) / scale) @ weight; ``at`` is the strength that scores CUT."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    at: float

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        x = np.array([features(t) for t in texts]).reshape(-1, len(self.weight))
        s = ((x - self.mean) / self.scale) @ self.weight - self.at + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = 100_000, quantile: float | None = None, decay: float = 1e-3,
        steps: int = 400, seed: int = 7) -> Ranking:
    """Bradley-Terry weights from the rows of ``x`` and their labels."""
    width = len(features(""))
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(a) or not len(b):
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -10, 10)
    rng = np.random.default_rng(seed)
    if len(a) * len(b) <= pairs:
        i, j = np.repeat(a, len(b)), np.tile(b, len(a))
    else:
        i, j = rng.choice(a, pairs), rng.choice(b, pairs)
    d = z[i] - z[j]
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):  # Adam on the whole loss
        g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -500, 500))))[:, None]).mean(axis=0) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    s = np.sort(z @ w)
    # between the last strength below the quantile and the first above it
    k = int(np.clip(round((len(b) / len(x) if quantile is None else quantile) * len(s)), 1, len(s) - 1)) if len(s) > 1 else 0
    return Ranking(mean, scale, w, float((s[k - 1] + s[k]) / 2))


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, sample: int = 20_000, text_col: str = "text") -> DataFrame:
    """(text, good) of at most ``sample`` labelled training rows; the labels are cut before documents are read."""
    told = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & train).select("doc_id", "quality").distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample))
    rows = told.collect()  # at most ``sample`` rows of two numbers
    spark = docs.sparkSession
    small = spark.createDataFrame([(r.doc_id, r.quality) for r in rows], "label_id long, quality int")
    return docs.join(F.broadcast(small), docs["doc_id"] == small["label_id"]).select(
        F.col(text_col).cast("string").alias("text"), (small["quality"] == 1).alias("good"))


def learn(docs: DataFrame, labels: DataFrame, train: Column, sample: int = 20_000, quantile: float | None = None) -> Ranking:
    """Fit on labelled rows whose id satisfies ``train``; features are made by the executors."""
    @F.pandas_udf("array<double>")
    def describe(text: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in text])

    got = labelled_sample(docs, labels, train, sample).select(describe("text").alias("x"), "good").toPandas()  # ``sample`` rows
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(features("")))
    order = np.lexsort((*x.T, got["good"].to_numpy(bool)))  # the same rows give the same model, however they arrive
    return fit(x[order], got["good"].to_numpy(bool)[order], quantile=quantile)


def score_quality(docs: DataFrame, model: Ranking, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score in column ``out``."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(told.value.score(text), dtype=float)

    return docs.withColumn(out, run(F.col(text_col).cast("string")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text of ``documents``, learned outside of the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = fold(F.col("doc_id"), 4) == 2
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    return score_quality(docs, model).select("doc_id", held.alias("held_out"), "score",
                                             F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
