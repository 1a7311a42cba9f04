"""Exact top-k search: term-at-a-time accumulation over blocks.

Every component of a vector is a term with an integer weight. Candidates and queries are dealt into blocks of
bounded size, and every pair of blocks meets in one group. There the candidates' weights form one postings list per
term (the candidates whose weight isn't zero); the query rows that hold the term scatter their weight
times the postings into a dense array of scores, a term after the other. A partition selects each query's
k best of the block, and a ranked window merges the blocks. The work is all queries times all rows by
definition; nothing is pruned, and no task holds more than two blocks.

Cases: vectors that are null or hold a null or non-finite component take no part, nor do rows without an id; rows that
share the query's id are its own; repeated query rows with equal vectors are one query, other candidates count once a
row; a shorter vector counts as padded with zeros; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAST = np.iinfo(np.int64).min


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """List column as a matrix, padded with zeros."""
    lists = column.combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return out


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of all queries against all rows of a block, a term at a time."""
    scores = np.zeros((len(queries), len(rows)), np.int64)
    for term in range(min(queries.shape[1], rows.shape[1])):
        posting = np.flatnonzero(rows[:, term])
        users = np.flatnonzero(queries[:, term])
        weight = rows[posting, term]
        if len(posting) == len(rows):
            for q in users.tolist():
                scores[q] += queries[q, term] * weight
        else:
            for q in users.tolist():
                scores[q, posting] += queries[q, term] * weight
    return scores


def select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and row index of each query's k best, ties to smaller ids, without the query's own rows."""
    mine = ids[None, :] == own[:, None]
    scores = np.where(mine, LEAST, scores)
    if k < scores.shape[1]:
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        q, r = np.nonzero((scores >= floor[:, None]) & ~mine)
    else:
        q, r = np.nonzero(~mine)
    order = np.lexsort((ids[r], -scores[q, r], q))
    q, r = q[order], r[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], r[place < k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id",
          vector_col: str = "embedding", query_block: int = 1024, row_block: int = 2048) -> DataFrame:
    """Each query's ``k`` best rows by the inner product of ``floor(scale * x)``: query_id, rank, vec_id, score."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~bad).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * F.lit(scale))).cast("array<bigint>").alias("v"),
        is_query.alias("is_query"))
    n, n_query = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_query"), 1))).first()
    blocks, query_blocks = max(1, -(-n // row_block)), max(1, -(-n_query // query_block))
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<bigint>"))
    queries = rows.where("is_query").groupBy("id", "v").agg(F.lit(1)).select(
        "id", "v", F.xxhash64("v").alias("key"), deal(F.col("id"), query_blocks).alias("qb"))
    queries = queries.withColumn("cb", every(blocks))
    rows = rows.select("id", "v", deal(F.monotonically_increasing_id(), blocks).alias("cb")).withColumn("qb", every(query_blocks))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own = right["id"].to_numpy(), left["id"].to_numpy()
        if len(ids) and len(own):
            scores = accumulate(matrix(left["v"]), matrix(right["v"]))
            q, r = select(scores, ids, own, k)
            cols = own[q], left["key"].to_numpy()[q], ids[r], scores[q, r]
        else:
            cols = [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("query_id", "key", "vec_id", "score"), map(pa.array, cols), strict=True)))

    best = queries.groupBy("qb", "cb").cogroup(rows.groupBy("qb", "cb")).applyInArrow(
        meet, "query_id long, key long, vec_id long, score long")
    by = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best rows of ``embeddings`` for every row whose id is divisible by 100."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 10
"""
