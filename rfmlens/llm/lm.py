"""Language-model scoring: a log-bilinear model in two levels, word classes and words, trained with noise-contrastive estimation.

Counts. One pass counts every word of every text (a map-side combine in each task, then a shuffle by word). Words
that hold more than ``1 / FREQUENT`` of all tokens, of which there are at most FREQUENT, are told to all tasks;
the counts of the others stay in a table and are joined to the words of the texts.

Model. The most frequent training words have vectors and lie in classes (``lm_vectors``); the end and the rest are classes of their own. The probability
of a token is that of its class, given the classes of the two words before, times that of the word in its class, given the word before.
Both are log-bilinear: the vector of a context is a linear map of the vectors of its parts, a score its product with the
vector of the class or word plus a bias. Classes are trained in numpy from the counts of class trigrams, words in rounds over the
counts of word pairs, each by telling what was seen from noise that is drawn from the frequencies. Batched matrix products
over all classes, and over all words, give the sums by which both are normalised exactly.

A word of the rest has its share of the rest's tokens; words never seen in training
together are one type there, whose share is the Good-Turing estimate. So the probabilities of the end, the training types and the
unseen type add up to 1 in every context. A text begins in the context of two ends.

Nothing depends on how the input is split: what is trained on are sums of counts, and noise comes from seeded generators.

Cases: a null or blank text is the end alone; null ids fall in the fold of the empty string and keep their rows;
repeated rows count and are scored each; texts of any length are scored in pieces of ``PIECE`` tokens; without training rows every token is
unseen; rare words are matched by their 64-bit hash; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rfmlens.llm import lm_vectors
from rfmlens.llm.common import cut_lineage
from rfmlens.llm.langid import fold

FREQUENT = 200_000
#: Tokens that are scored at once.
PIECE = 100_000
#: A task's counter is passed on when it has so many words.
HELD = 300_000


def split(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    return (text or "").encode("utf-8", "replace").lower().split()


def rows_of(docs: DataFrame, train: Column, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"))


def count_words(rows: DataFrame) -> DataFrame:
    """word, n (training tokens), n_all (all tokens); the null word counts the ends."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, ends = Counter(), Counter(), [0, 0]

        def out(parts: list[tuple[Counter, int]]) -> Iterator[pa.RecordBatch]:
            for c, train in parts:
                if c:
                    n = np.fromiter(c.values(), np.int64, len(c))
                    yield pa.RecordBatch.from_pydict({"word": pa.array(list(c), pa.binary()), "n": n * train, "n_all": n})
                    c.clear()

        for batch in batches:
            for text, train in zip(batch.column("text").to_pylist(), batch.column("train").to_pylist(), strict=True):
                (seen if train else held).update(split(text))
                ends[0] += train
                ends[1] += 1
                if len(seen) + len(held) > HELD:
                    yield from out([(seen, 1), (held, 0)])
        yield from out([(seen, 1), (held, 0)])
        yield pa.RecordBatch.from_pydict({"word": pa.array([None], pa.binary()), "n": [ends[0]], "n_all": [ends[1]]})

    return rows.mapInArrow(count, "word binary, n long, n_all long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def train_nce(trigrams: np.ndarray, width: int = 24, noise: float = 25.0, steps: int = 300, drawn: int = 200_000, seed: int = 3) -> np.ndarray:
    """log10 P(class | two classes before), a row for each context, from counts of shape (C, C, C).

    Each step draws ``drawn`` pairs of a context and a noise class, by their frequencies, which stand for ``noise`` of them for each token.
    """
    c = trigrams.shape[0]
    count = trigrams.reshape(c * c, c).astype(np.float64)
    total = count.sum()
    q = (count.sum(axis=0) + 0.5) / (total + 0.5 * c)
    rng = np.random.default_rng(seed)
    par = [rng.normal(0, 0.1, (c, width)), rng.normal(0, 0.1, (width, width)), rng.normal(0, 0.1, (width, width)),
           rng.normal(0, 0.1, (c, width)), np.log(q)]  # vectors of contexts, map of either place, vectors of classes, bias
    if total:
        used = np.flatnonzero(count.sum(axis=1))
        a, b = used // c, used % c
        count = count[used] / total
        contexts, classes = np.cumsum(count.sum(axis=1)), np.cumsum(q)
        shift = np.log(noise * q)
        m, v = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
        for t in range(1, steps + 1):
            r, far, near, out, bias = par
            at = np.minimum(np.searchsorted(contexts, rng.random(drawn) * contexts[-1]), len(used) - 1) * c
            at += np.minimum(np.searchsorted(classes, rng.random(drawn) * classes[-1]), c - 1)
            false = np.bincount(at, minlength=len(used) * c).reshape(-1, c) * (noise / drawn)
            h = r[a] @ far + r[b] @ near
            real = 1 / (1 + np.exp(-np.clip(h @ out.T + bias - shift, -50, 50)))
            g = false * real - count * (1 - real)
            gh = g @ out
            gr = np.zeros_like(r)
            np.add.at(gr, a, gh @ far.T)
            np.add.at(gr, b, gh @ near.T)
            grad = [gr, r[a].T @ gh, r[b].T @ gh, g.T @ h, g.sum(axis=0)]
            rate = 0.03 if t < 0.7 * steps else 0.006
            for i, x in enumerate(grad):
                m[i], v[i] = 0.9 * m[i] + 0.1 * x, 0.999 * v[i] + 0.001 * x * x
                par[i] = par[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-10)
    r, far, near, out, bias = par
    s = ((r @ far)[:, None, :] + (r @ near)[None, :, :]).reshape(c * c, width) @ out.T + bias
    s -= s.max(axis=1, keepdims=True)
    return (s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / np.log(10)


@dataclass
class Model:
    """words: the frequent ones, in descending order of n, their training counts; the first ``size`` have vectors.

    kind: class of each word with a vector, then of REST and END, which are classes of their own; table: log10 probabilities of classes, a row
    for each pair of them; share: logarithm of a word's share in its class; sums: logarithms of the classes' sums; rare: (h, n) of the other training words.
    """

    words: list[bytes]
    n: np.ndarray
    size: int
    kind: np.ndarray
    ends: int
    tokens: int
    types: int
    unseen: float
    rest: int
    table: np.ndarray
    r: np.ndarray
    q: np.ndarray
    share: np.ndarray
    sums: np.ndarray
    rare: DataFrame | None

    @property
    def classes(self) -> int:
        return int(self.kind[-1]) + 1

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1) / (self.tokens + self.types + 1))

    def within(self, n: np.ndarray) -> np.ndarray:
        """log10 share of the rest of a word with n training tokens."""
        share = np.where(n > 0, n * (1 - self.unseen) / max(1, self.rest), self.unseen)
        return np.log10(np.maximum(share, 1e-300))

    def tables(self) -> tuple:
        """What tasks need to score: words, counts, base and rest scores of each, arrays of the model."""
        n = self.n
        rest = np.where(np.arange(len(n)) < self.size, 0.0, self.within(n))
        return (self.words, n, self.base(n), rest, self.size, self.kind, self.table, self.r, self.q, self.share, self.sums,
                float(self.base(np.array(self.ends))), self.ends > 0)


def log_probs(x: np.ndarray, size: int, kind: np.ndarray, table: np.ndarray, r: np.ndarray, q: np.ndarray, share: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """log10 probability of each id after its two predecessors: of its class, and in it unless it is REST or END."""
    c, classes = kind[x], int(kind[-1]) + 1
    out = table[c[:-2] * classes + c[1:-1], c[2:]]
    at = np.flatnonzero(x[2:] < size)
    a, b = x[at + 1], x[at + 2]
    f = np.einsum("id,id->i", r[a], q[b, :-1]) + q[b, -1] + share[b] - sums[a, kind[b]]
    out[at] += f / np.log(10)
    return out


def learn(rows: DataFrame) -> Model:
    """Count all rows and train on the training rows."""
    vocab = cut_lineage(count_words(rows), "vocabulary")
    end = F.col("word").isNull()
    is_train = (F.col("n") > 0).cast("int")
    tokens, types, n_all, ends = vocab.agg(F.sum("n"), F.sum(is_train), F.sum("n_all"), F.sum(F.when(end, F.col("n")))).first()
    tokens, types, n_all, ends = tokens or 0, types or 0, n_all or 0, ends or 0
    is_frequent = F.col("n_all") * FREQUENT > F.lit(n_all)
    known = sorted(vocab.where(~end & is_frequent).select("word", "n").collect(), key=lambda r: (-r.n, bytes(r.word)))  # fewer than FREQUENT rows
    words, n = [bytes(r.word) for r in known], np.array([r.n for r in known], np.int64)
    size = min(lm_vectors.VECTORS, int((n > 0).sum()))
    rest = tokens - ends - int(n[:size].sum())
    once = vocab.where(~end & (F.col("n") == 1)).count()
    unseen = min(0.5, max(once, 1) / (rest + 1)) if rest else 1.0

    pairs = lm_vectors.word_pairs(rows, words[:size], split)
    after, before = lm_vectors.neighbour_shares(pairs, size)
    kind = lm_vectors.classes_of(np.concatenate([after, before], axis=1)[:size])
    r, q = lm_vectors.train(pairs, kind, n[:size], lm_vectors.main_parts(after))
    share, sums = lm_vectors.log_sums(r, q, kind, n[:size])
    classes = (int(kind.max()) + 1 if size else 0) + 2
    kind = np.concatenate([kind, [classes - 2, classes - 1]])
    told = rows.sparkSession.sparkContext.broadcast((words[:size], kind))

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ws, kinds = told.value
        find, total = {w: i for i, w in enumerate(ws)}.get, np.zeros(classes**3, np.int64)
        held, count = [], 0

        def add() -> None:
            np.add(total, np.bincount(np.concatenate(held), minlength=classes**3), out=total)
            held.clear()

        for batch in batches:
            for text in batch.column("text").to_pylist():
                w = split(text)
                x = np.full(len(w) + 3, len(ws) + 1)
                x[2:-1] = np.fromiter(map(find, w, repeat(len(ws))), np.int64, len(w))
                c = kinds[x]
                held.append((c[:-2] * classes + c[1:-1]) * classes + c[2:])
                count += len(c)
                if count > lm_vectors.COUNTED:
                    add()
                    count = 0
        if held:
            add()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": at.astype(np.int32), "n": total[at]})

    got = rows.where("train").select("text").mapInArrow(trigrams, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # classes ** 3 rows at most
    count = np.zeros(classes**3)
    count[got["code"].to_numpy()] = got["n"].to_numpy()
    return Model(words, n, size, kind, ends, tokens, types, unseen, rest, train_nce(count.reshape(classes, classes, classes)), r, q, share, sums,
                 vocab.where(~end & ~is_frequent & (F.col("n") > 0)).select(F.xxhash64("word").alias("h"), "n"))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    m = model
    told = rows.sparkSession.sparkContext.broadcast(m.tables())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ws, n, base, within, size, *arrays, end_base, end_known = told.value
        find, seen = {w: i for i, w in enumerate(ws)}.get, n > 0
        for batch in batches:
            for part in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                count, known, b, s, tail = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    w = split(text)
                    at = np.fromiter(map(find, w, repeat(-1)), np.int64, len(w))
                    x = np.full(len(w) + 3, size + 1)
                    x[2:-1] = np.where((at < 0) | (at >= size), size, at)
                    hit = at[at >= 0]
                    total = sum(float(log_probs(x[i:i + PIECE + 2], size, *arrays).sum()) for i in range(0, len(w) + 1, PIECE))
                    count.append(len(w) + 1)
                    known.append(int(seen[hit].sum()) + end_known)
                    b.append(float(base[hit].sum()) + end_base)
                    s.append(total + float(within[hit].sum()))
                    tail.append([w[i] for i in np.flatnonzero(at < 0).tolist()])
                yield pa.RecordBatch.from_pydict({
                    "row": part.column("row"), "doc_id": part.column("doc_id"), "train": part.column("train"), "n_tokens": pa.array(count, pa.int64()),
                    "known": pa.array(known, pa.int64()), "base": pa.array(b, pa.float64()), "model": pa.array(s, pa.float64()), "tail": pa.array(tail, pa.list_(pa.binary()))})

    told_rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        run, "row long, doc_id long, train boolean, n_tokens long, known long, base double, model double, tail array<binary>"), "lm-texts")
    tail = told_rows.select("row", F.explode("tail").alias("word")).select("row", F.xxhash64("word").alias("h"))
    n = F.coalesce("n", F.lit(0))
    tail = tail.join(m.rare, "h", "left").groupBy("row").agg(
        F.count("n").alias("t_known"), F.sum(F.log10((n + 1) / F.lit(float(m.tokens + m.types + 1)))).alias("t_base"),
        F.sum(F.when(n > 0, F.log10(n * F.lit((1 - m.unseen) / max(1, m.rest)))).otherwise(F.lit(float(np.log10(m.unseen))))).alias("t_model"))
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return told_rows.drop("tail").join(tail, "row", "left").select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", add("known", "t_known").alias("n_known"),
        F.lit(m.tokens).cast("long").alias("train_tokens"), add("base", "t_base").alias("base_score"), add("model", "t_model").alias("score"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole texts of ``documents``, learned outside of the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = rows_of(docs, fold(F.col("doc_id"), 7) != 2, "doc_id", "text")
    return score(rows, learn(rows))
