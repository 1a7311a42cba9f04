"""Language identification as a mixture of languages.

Learning counts hashed byte trigrams of all training texts per language. A document is explained as a
mixture: expectation-maximisation estimates the share of each language from the n-gram likelihoods, all documents of a
block at once in matrix products, each until no share of its own moves by ``SETTLED``. That ends: a round that moves shares by d gains at least
n * d^2 / 2 of log-likelihood. Among the nested sets of its largest shares the document gets the one with
the highest log-likelihood less ``penalty * log(n)`` for each further language; its prediction is the largest share
of that set, which is also its score.

Cases: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learned; rows without a
language, or whose text has no letter, teach nothing; null ids count as held out (crc32 of the empty string); ties go to the language that
sorts first; repeated rows get a row each; other columns are kept by ``identify`` and ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UND = "und"
BUCKETS = 4096
#: A document's shares are found when a round moves none of them by so much.
SETTLED = np.float32(1e-4)
BLOCK = 128
#: ASCII other than letters becomes a space.
SPACED = bytes(c if c >= 0x80 or 97 <= c <= 122 else 32 for c in range(256))


def fold(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of the hashed byte trigrams of the letters; whatever isn't a letter separates words."""
    b = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(SPACED).split()) + b" "
    x = np.frombuffer(b, np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(buckets, np.int64)
    h = (x[:-2] | x[1:-1] << 8 | x[2:] << 16) * np.uint32(2654435761) >> np.uint32(15)
    return np.bincount(h % np.uint32(buckets), minlength=buckets)


@dataclass(frozen=True)
class Languages:
    """names: sorted; p: a row of n-gram probabilities for each."""

    names: tuple[str, ...]
    p: np.ndarray

    def shares(self, x: np.ndarray, penalty: float) -> np.ndarray:
        """Share of each language (0 outside the chosen set) for a matrix of counts, a row for each document."""
        x = x.astype(np.float64)
        n = x.sum(axis=1)
        cost = penalty * np.log(np.maximum(n, 2))
        one = x @ np.log(self.p).T
        best = np.zeros_like(one)
        best[np.arange(len(x)), one.argmax(axis=1)] = 1
        top = one.max(axis=1)
        size = len(self.names)
        if size == 1:
            return best
        full = self._em(x, np.full_like(one, 1 / size))
        most = self._ll(x, full)
        rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
        for k in range(2, size + 1):
            # no set of k languages explains a document better than all of them do
            left = np.flatnonzero(most - (k - 1) * cost > top)
            if not len(left):
                break
            start = np.where(rank[left] < k, full[left], 0)
            pi = full[left] if k == size else self._em(x[left], start / start.sum(axis=1, keepdims=True))
            value = self._ll(x[left], pi) - (k - 1) * cost[left]
            better = value > top[left]
            best[left[better]], top[left[better]] = pi[better], value[better]
        return best

    def _em(self, x: np.ndarray, pi: np.ndarray) -> np.ndarray:
        p, x, pi = self.p.astype(np.float32), x.astype(np.float32), pi.astype(np.float32)
        n = np.maximum(x.sum(axis=1, keepdims=True), 1)
        moving = np.arange(len(x))
        while len(moving):
            before = pi[moving]
            pi[moving] = before * ((x / (before @ p)) @ p.T) / n
            on = np.abs(pi[moving] - before).max(axis=1) >= SETTLED
            if not on.all():
                moving, x, n = moving[on], x[on], n[on]
        pi = pi.astype(np.float64)
        return pi / pi.sum(axis=1, keepdims=True)

    def _ll(self, x: np.ndarray, pi: np.ndarray) -> np.ndarray:
        return (x * np.log(pi @ self.p)).sum(axis=1)

    def predict(self, texts: list[str | None], penalty: float) -> tuple[list[str], np.ndarray, list[list[str]]]:
        """Largest share's language, that share, and the set by falling share."""
        lang, score, sets = [UND] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
        known = [i for i, t in enumerate(texts) if self.names and has_letter(t)]
        for a in range(0, len(known), BLOCK):
            at = known[a:a + BLOCK]
            share = self.shares(np.stack([grams(texts[i], self.p.shape[1]) for i in at]), penalty)
            order = np.argsort(-share, axis=1, kind="stable")
            for i, s, o in zip(at, share, order.tolist(), strict=True):
                lang[i], score[i] = self.names[o[0]], min(1.0, float(s[o[0]]))
                sets[i] = [self.names[j] for j in o if s[j] > 0]
        return lang, score, sets


def learn(docs: DataFrame, train: Column, lang_col: str = "lang", text_col: str = "text", buckets: int = BUCKETS,
          smooth: float = 0.5) -> Languages:
    """Count the trigrams of all training rows; what reaches the driver is a count for each language and bucket."""
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if has_letter(text):
                    total[lang] = total.get(lang, 0) + grams(text, buckets)
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": at.astype(np.int32), "n": c[at]})

    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = tuple(sorted(counts["lang"].unique()))
    c = np.zeros((len(names), buckets))
    if names:
        c[np.searchsorted(names, counts["lang"]), counts["bucket"]] = counts["n"]
    c += smooth
    return Languages(names, c / c.sum(axis=1, keepdims=True))


def identify(docs: DataFrame, model: Languages, text_col: str = "text", penalty: float = 4.0, out: str = "language") -> DataFrame:
    """``docs`` with a column ``out``: struct of lang, score and the set of languages."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, languages array<string>")
    def run(text: pd.Series) -> pd.DataFrame:
        lang, score, sets = told.value.predict(list(text), penalty)
        return pd.DataFrame({"lang": lang, "score": score, "languages": sets})

    return docs.withColumn(out, run(F.col(text_col).cast("string")))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, learned outside of the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 5) == 0
    told = identify(docs.select("doc_id", "text"), learn(docs, ~held))
    return told.select("doc_id", held.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
