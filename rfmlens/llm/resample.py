"""Importance resampling towards a target distribution: hashed n-gram features, gains of buckets, Gumbel top-k.

Features of a text are all runs of 1 to ``n`` words, joined by one space, each in the bucket of its CRC-32. The buckets' counts over all
documents and over all target texts give each bucket a gain, the logarithm of the smoothed ratio of its shares; a document's weight is the mean
gain of its features, and adding a Gumbel variable, made from its id, turns the highest scores into a draw without replacement.

Both passes over the texts take blocks of about ``BLOCK`` bytes. A block's words are put into one buffer with one space between, so that every
n-gram is a piece of it. ``Interned`` is an open-addressed numpy table that gives equal n-grams one slot: keys are xxhash64 of the
bytes, places are probed one after another, and a place is shared only after the bytes were compared. A slot stores the n-gram's
bucket, computed once, and its count; the first pass sums the counts by bucket, the second gathers gains by the slot of every occurrence.
A task passes on one row for each bucket and document; nothing grows with the vocabulary. The draw takes its
rank from ranges of all scores (``operators.order``).

Cases: null texts and texts without words have no features and weight 0; a null id counts as the empty string in the hash; equal ids with equal
scores are ordered by weight, features and text; repeated rows are rows; with fewer than 4 texts of ``LEAST_WORDS`` words
nothing is drawn at a share of a quarter; an empty target gives all buckets the gain of no count; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rfmlens.llm.common import cut_lineage
from rfmlens.operators.order import global_row_number

N = 2
BUCKETS = 10_000
PERCENT, SEED, LEAST_WORDS = 25, 7, 20
#: Bytes of text that are interned at once (one longer text is a block of its own).
BLOCK = 2_000_000

#: Lower case of A-Z; a space for what isn't in a word.
TABLE = np.full(256, 32, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    TABLE[_b] = _b
TABLE[0x41:0x5B] = TABLE[0x61:0x7B]

# The constants of XXH64, fixed by its specification.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _lanes(buffer: np.ndarray, width: int) -> np.ndarray:
    """The little-endian number of ``width`` bytes at every place of the buffer, which has ``width`` bytes more than are asked for."""
    return np.ndarray((len(buffer) - width + 1,), f"<u{width}", buffer, strides=(1,))


def xxhash64(buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of the pieces; ``buffer`` has 8 spare bytes at its end."""
    h = P5 + length.astype(np.uint64)
    eight, four = _lanes(buffer, 8), _lanes(buffer, 4)
    at, rest = start.copy(), np.where(length < 32, length, 0)
    while len(todo := np.flatnonzero(rest >= 8)):
        k = _rot(eight[at[todo]] * P2, 31) * P1
        h[todo] = _rot(h[todo] ^ k, 27) * P1 + P4
        at[todo] += 8
        rest[todo] -= 8
    todo = np.flatnonzero(rest >= 4)
    h[todo] = _rot(h[todo] ^ four[at[todo]].astype(np.uint64) * P1, 23) * P2 + P3
    at[todo] += 4
    rest[todo] -= 4
    while len(todo := np.flatnonzero(rest > 0)):
        h[todo] = _rot(h[todo] ^ buffer[at[todo]].astype(np.uint64) * P5, 11) * P1
        at[todo] += 1
        rest[todo] -= 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    data = buffer.data
    for i in np.flatnonzero(length >= 32).tolist():  # pieces of four lanes and more are few
        h[i] = xxhash.xxh64_intdigest(data[start[i]:start[i] + length[i]])
    return h


class Interned:
    """Slots of equal pieces of a buffer: ``slot`` of every piece; ``bucket`` and ``count`` of every slot."""

    def __init__(self, buffer: np.ndarray, start: np.ndarray, length: np.ndarray, buckets: int, keys: np.ndarray | None = None):
        n = len(start)
        keys = xxhash64(buffer, start, length) if keys is None else keys
        size = 1 << max(4, (2 * n).bit_length())
        table = np.full(size, -1, np.int64)  # the piece that holds a place
        mask = np.uint64(size - 1)
        place = (keys & mask).astype(np.int64)
        owner = np.full(n, -1, np.int64)
        todo = np.arange(n)
        while len(todo):
            at = place[todo]
            free = table[at] < 0
            table[at[free]] = todo[free]  # of those that want one place, one gets it
            held = table[at]
            same = (keys[held] == keys[todo]) & (length[held] == length[todo])
            same[same] = _equal(buffer, start[held[same]], start[todo[same]], length[todo[same]])
            owner[todo[same]] = held[same]
            todo = todo[~same]
            place[todo] = (place[todo] + 1) & (size - 1)
        first = np.flatnonzero(owner == np.arange(n))
        self.slot = (np.cumsum(owner == np.arange(n)) - 1)[owner]
        self.count = np.bincount(self.slot, minlength=len(first))
        data = buffer.data
        self.bucket = np.fromiter((zlib.crc32(data[a:a + k]) % buckets for a, k in zip(start[first].tolist(), length[first].tolist(), strict=True)),
                                  np.int64, len(first))


def _equal(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the pieces at a and b, of one length each, have the same bytes."""
    eight, ok, at = _lanes(buffer, 8), np.ones(len(a), bool), 0
    todo = np.flatnonzero(a != b)
    while len(todo := todo[length[todo] > at]):
        x = eight[a[todo] + at] ^ eight[b[todo] + at]
        more = np.minimum(length[todo] - at, 8).astype(np.uint64)
        x <<= (np.uint64(8) - more) * np.uint64(8)  # bytes beyond the end don't count
        ok[todo] &= x == 0
        todo, at = todo[ok[todo]], at + 8
    return ok


def features(texts: Sequence[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer of all words; start, length and text of every n-gram; the number of words of each text."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    size = np.array([len(r) + 1 for r in raw], np.int64)
    b = TABLE[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]
    word = b != 32
    first = word & ~np.concatenate(([False], word[:-1]))
    keep = word | np.concatenate(([False], word[:-1]))  # one space after each word
    text_of_byte = np.repeat(np.arange(len(raw)), size)
    of = text_of_byte[first]
    buffer = b[keep]
    start = np.flatnonzero(np.concatenate(([True], buffer[:-1] == 32))) if len(buffer) else np.zeros(0, np.int64)
    end = np.flatnonzero(buffer == 32)
    starts, lengths, texts_of = [], [], []
    for k in range(min(n, len(start))):
        same = of[:len(of) - k] == of[k:]
        a = start[:len(start) - k][same]
        starts.append(a)
        lengths.append(end[k:][same] - a)
        texts_of.append(of[:len(of) - k][same])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return np.concatenate([buffer, np.zeros(16, np.uint8)]), join(starts), join(lengths), join(texts_of), np.bincount(of, minlength=len(raw))


def blocks(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about ``BLOCK`` bytes of text each."""
    size = np.cumsum(np.array([len(t or "") for t in batch.column(column).to_pylist()], np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + BLOCK)))
        yield batch.slice(a, b - a)
        a = b


def bucket_counts(texts: DataFrame, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; ``texts`` has the one column ``text``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in blocks(batch):
                buffer, start, length, _, _ = features(part.column("text").to_pylist(), n)
                found = Interned(buffer, start, length, buckets)
                total += np.bincount(found.bucket, found.count, buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    got = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row a bucket at most
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of every bucket, in thousandths of a natural logarithm, rounded down."""
    s, t, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float((b + 1) * (s + k)) / float((a + 1) * (t + k)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight and text_hash of every row."""
    told = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = told.value
        for batch in batches:
            for part in blocks(batch):
                buffer, start, length, of, words = features(part.column("text").to_pylist(), n)
                found = Interned(buffer, start, length, len(gain))
                count = np.bincount(of, minlength=part.num_rows)
                total = np.bincount(of, gain[found.bucket][found.slot], part.num_rows).astype(np.int64)  # whole numbers below 2 ** 53
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "n_words": pa.array(words, pa.int64()),
                                                  "n_features": pa.array(count, pa.int64()), "weight": pa.array(total // np.maximum(count, 1), pa.int64())})

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, n: int = N, buckets: int = BUCKETS,
             least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank (null unless drawn) of every row of ``docs``."""
    texts = lambda df, c: df.select(F.col(c).cast("string").alias("text"))
    gains = bucket_gains(bucket_counts(texts(docs, text_col), n, buckets), bucket_counts(texts(target, target_text_col), n, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = cut_lineage(weigh(docs, gains, n, id_col, text_col).withColumn("score", F.col("weight") + gumbel), "resample-scores")
    enough = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    drawn = percent * scored.where(enough).count() // 100
    placed = global_row_number(scored.withColumn("too_short", ~enough), ["too_short", F.desc("score"), "doc_id", "weight", "n_features", "text_hash"], out="place")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of 20 words and more, drawn towards the distribution of ``benchmark``."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
