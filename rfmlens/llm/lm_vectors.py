"""Vectors of the log-bilinear model of ``lm``: word classes, training in rounds of Spark jobs, exact sums within the classes.

Pairs. One pass counts the pairs of neighbouring words over all training texts; a word without a vector is REST, and texts end in END. What the
training reads afterwards is this table, at most (VECTORS + 2) ** 2 rows, grouped by the word before.

Classes. Words are halved again and again at the median of the main direction of their neighbours' shares, until a class holds about
the square root of their number. So classes are of one size and hold words of like contexts (of one language, first of all).

Vectors. P(word | its class, word before) is proportional to the word's share of its class times ``exp(f)``, where f is the product of the
vector of the word before with the word's own, plus a bias. Noise-contrastive estimation tells the word from ``NOISE`` others drawn from its class by
their shares. Training goes in rounds: the vectors are broadcast, each task sums the gradients of its rows of the table, and the step
is taken once a round on the driver. Rows are dealt to ``SLICES`` tasks by the word before and noise is drawn by a generator seeded by that word and
the round, so neither the number of partitions of the input nor their order changes the vectors.

Sums. ``log_sums`` gives the logarithm of each class's sum for each word before, by batched matrix products over all words: probabilities are normalised exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rfmlens.llm.common import cut_lineage

#: Words with vectors of their own: the most frequent ones of training.
VECTORS = 8192
WIDTH, NOISE, ROUNDS, RATE, PRIOR = 16, 4, 16, 0.25, 1.0
SLICES = 4
#: Frequent words whose shares as neighbours tell the classes.
NEIGHBOURS = 64
#: Tokens whose pairs a task counts at once; pairs whose gradients it sums at once.
COUNTED, SUMMED = 2_000_000, 50_000


def word_pairs(rows: DataFrame, words: list[bytes], split) -> DataFrame:  # noqa: ANN001
    """(a, b, n): how often b comes right after a, by the places of the words in ``words``; len(words) is REST, len(words) + 1 END."""
    told = rows.sparkSession.sparkContext.broadcast(words)
    rest, end = len(words), len(words) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held, size = {w: i for i, w in enumerate(told.value)}.get, [], 0

        def out() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_pydict({"a": pa.array((code // (end + 1)).astype(np.int32)), "b": pa.array((code % (end + 1)).astype(np.int32)), "n": pa.array(n, pa.int64())})

        for batch in batches:
            for text in batch.column("text").to_pylist():
                w = split(text)
                x = np.full(len(w) + 2, end)
                x[1:-1] = np.fromiter(map(find, w, repeat(rest)), np.int64, len(w))
                held.append(x[:-1] * (end + 1) + x[1:])
                size += len(x)
                if size > COUNTED:
                    yield out()
                    size = 0
        if held:
            yield out()

    got = rows.where("train").select("text").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return cut_lineage(got, "lm-pairs")


def neighbour_shares(pairs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of the shares of the frequent words among those after and before each word (rows: all ids, columns: frequent ones, REST, END)."""
    top = min(NEIGHBOURS, size)
    column = np.full(size + 2, -1)
    column[:top] = np.arange(top)
    column[size:] = [top, top + 1]
    is_top = lambda c: (F.col(c) < top) | (F.col(c) >= size)
    got = pairs.where(is_top("a") | is_top("b")).toArrow()  # at most 2 * (NEIGHBOURS + 2) * (VECTORS + 2) rows
    a, b, n = (got[c].to_numpy() for c in ("a", "b", "n"))
    out = []
    for x, y in ((a, b), (b, a)):
        m = np.zeros((size + 2, top + 2))
        ok = column[y] >= 0
        m[x[ok], column[y[ok]]] = n[ok]
        out.append(np.sqrt(m / np.maximum(m.sum(axis=1, keepdims=True), 1)))
    return out[0], out[1]


def classes_of(shares: np.ndarray) -> np.ndarray:
    """Class of each row: classes of about the square root of their number, of equal size but for one."""
    kind = np.zeros(len(shares), np.int64)
    groups = [np.arange(len(shares))]
    for _ in range(round(np.log2(max(1, len(shares))) / 2)):
        halves = []
        for g in groups:
            x = shares[g] - shares[g].mean(axis=0)
            way = np.linalg.svd(x, full_matrices=False)[2][0]
            way = way * np.sign(way[np.argmax(np.abs(way))])
            order = g[np.argsort(np.round(x @ way, 9), kind="stable")]
            halves += [order[:(len(g) + 1) // 2], order[(len(g) + 1) // 2:]]
        groups = [g for g in halves if len(g)]
    for k, g in enumerate(groups):
        kind[g] = k
    return kind


def main_parts(shares: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """First vectors of the words before: the main parts of what follows them, of unit spread."""
    x = shares - shares.mean(axis=0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    out = np.zeros((len(shares), width))
    k = min(width, u.shape[1])
    out[:, :k] = u[:, :k] * np.sign(u[np.argmax(np.abs(u[:, :k]), axis=0), np.arange(k)])
    return out / np.maximum(out.std(axis=0), 1e-9) * (out.std(axis=0) > 1e-9) / np.sqrt(width) * 2


def gradients(a: np.ndarray, b: np.ndarray, n: np.ndarray, noise: np.ndarray, r: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of r (rows as ``a``) and of q (vectors and bias, summed by word) for pairs (a, b) of weight n and their noise words."""
    width = r.shape[1]
    h = np.concatenate([r[a], np.ones((len(a), 1))], axis=1)
    word = np.concatenate([b[:, None], noise], axis=1)
    f = np.einsum("id,ijd->ij", h, q[word]) - np.log(noise.shape[1])
    p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    g = -p * n[:, None]
    g[:, 0] += n
    gr = np.einsum("ij,ijd->id", g, q[word][:, :, :width])
    at, gq = word.ravel(), np.zeros_like(q)
    for d in range(width + 1):
        gq[:, d] = np.bincount(at, (g * h[:, d:d + 1]).ravel(), len(q))
    return gr, gq


def train(pairs: DataFrame, kind: np.ndarray, n: np.ndarray, r: np.ndarray, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the words before (all ids) and of the words (with a bias); ``kind`` and ``n``: class and count of each word."""
    spark, size, width, rounds = pairs.sparkSession, len(kind), r.shape[1], rounds or ROUNDS
    q = np.zeros((size, width + 1))
    if not size:
        return r, q
    order = np.argsort(kind, kind="stable")
    upto = np.concatenate(([0.0], np.cumsum(n[order].astype(np.float64))))
    place = np.concatenate(([0], np.cumsum(np.bincount(kind))))
    rows = pairs.where(F.col("b") < size).groupBy("a").agg(F.sort_array(F.collect_list(F.struct("b", "n"))).alias("x"))  # at most VECTORS each
    rows = rows.select("a", F.transform("x", lambda x: x["b"]).alias("b"), F.transform("x", lambda x: x["n"].cast("double")).alias("n"))
    rows = cut_lineage(rows.repartitionById(SLICES, F.col("a") % SLICES).sortWithinPartitions("a"), "lm-contexts")
    fixed = spark.sparkContext.broadcast((kind, order, upto, place))

    def round_of(t: int, r: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        told = spark.sparkContext.broadcast((r, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (r, q), (kind, order, upto, place) = told.value, fixed.value
            total, gr = np.zeros_like(q), np.zeros_like(r)
            for batch in batches:
                a, size_of = batch.column("a").to_numpy(), np.diff(batch.column("b").offsets.to_numpy())
                b, n = batch.column("b").flatten().to_numpy(), batch.column("n").flatten().to_numpy()
                ends = np.cumsum(size_of)
                at = 0
                while at < len(a):
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SUMMED)))
                    some = slice(int(ends[at - 1]) if at else 0, int(ends[to - 1]))
                    u = np.concatenate([np.random.default_rng([t, int(x)]).random((int(k), NOISE)) for x, k in zip(a[at:to], size_of[at:to], strict=True)])
                    c = kind[b[some]]
                    low, high = upto[place[c]][:, None], upto[place[c + 1]][:, None]
                    drawn = np.searchsorted(upto, low + u * (high - low), side="right") - 1
                    noise = order[np.clip(drawn, place[c][:, None], place[c + 1][:, None] - 1)]
                    whose = np.repeat(a[at:to], size_of[at:to])
                    x, y = gradients(whose, b[some], n[some], noise, r, q)
                    for d in range(r.shape[1]):
                        gr[:, d] += np.bincount(whose, x[:, d], len(r))
                    total += y
                    at = to
            own = np.flatnonzero(np.abs(gr).sum(axis=1))
            yield pa.RecordBatch.from_pydict({"a": pa.array([own.astype(np.int32).tobytes()]), "gr": pa.array([gr[own].astype(np.float32).tobytes()]),
                                              "gq": pa.array([total.astype(np.float32).tobytes()])})

        got = rows.mapInArrow(run, "a binary, gr binary, gq binary").collect()  # SLICES rows or fewer, of the vectors' size
        told.destroy()
        gr, gq = np.zeros_like(r), np.zeros_like(q)
        for x in sorted(got, key=lambda x: bytes(x.a)):
            gr[np.frombuffer(x.a, np.int32)] += np.frombuffer(x.gr, np.float32).reshape(-1, width)
            gq += np.frombuffer(x.gq, np.float32).reshape(q.shape)
        return gr, gq

    m, v = [np.zeros_like(r), np.zeros_like(q)], [np.zeros_like(r), np.zeros_like(q)]
    first = r.copy()
    for t in range(1, rounds + 1):
        gr, gq = round_of(t, r, q)
        rate = RATE * (1 - 0.9 * (t - 1) / rounds)
        step = []
        for i, g in enumerate((gr - PRIOR * (r - first), gq - PRIOR * q)):
            m[i], v[i] = 0.8 * m[i] + 0.2 * g, 0.95 * v[i] + 0.05 * g * g
            step.append(rate * (m[i] / (1 - 0.8**t)) / (np.sqrt(v[i] / (1 - 0.95**t)) + 1e-6))
        r, q = r + 0.25 * step[0], q + step[1]
    return r.astype(np.float32).astype(np.float64), q.astype(np.float32).astype(np.float64)


def log_sums(r: np.ndarray, q: np.ndarray, kind: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of the share of each word in its class, and of each class's sum for each word before."""
    size, classes = len(kind), int(kind.max()) + 1 if len(kind) else 0
    if not size:
        return np.zeros(0), np.zeros((len(r), 0))
    share = np.log(n / np.bincount(kind, n)[kind])
    order = np.argsort(kind, kind="stable")
    place = np.concatenate(([0], np.cumsum(np.bincount(kind))))[:-1]
    out = np.zeros((len(r), classes))
    for a in range(0, len(r), 256):
        f = r[a:a + 256] @ q[order, :-1].T + (q[order, -1] + share[order])
        top = np.maximum.reduceat(f, place, axis=1)
        out[a:a + 256] = np.log(np.add.reduceat(np.exp(f - top[:, kind[order]]), place, axis=1)) + top
    return share, out
