"""Sharding by longest processing time: groups of equal texts, largest first, go to the least-loaded shard.

The schedule only depends on the sizes: groups of one size may be exchanged. So Spark counts the groups of each size, the heap runs over
these counts on the driver, and a size's groups are dealt to its shards by their number among them. A run of many equal
sizes is put down at once, as the heap would have done it one by one. Sizes that differ are few: sizes of d kinds add up to
d * d / 2 bytes at least, so of B bytes there are at most sqrt(2 * B) kinds, each a pair of numbers on the driver.

Texts never move: rows are told apart by a digest of 32 bytes. A group of any size is joined to its shard without meeting in one task
(``common.lookup``), and slots come from ranges of all rows (``operators.order``), not from a window over a shard.

Cases: a null text is an empty one (size 8) and in its group; null ids are ids; repeated rows are rows of one group, each with its own slot; an
empty table gives no rows; a group larger than a shard's fair part has a shard for itself until the others have as much; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rfmlens.llm.common import cut_lineage, lookup
from rfmlens.operators.order import global_row_number

SHARDS = 24
#: Bytes of a row besides its text.
ROW_BYTES = 8


def _level(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of ``size`` bytes the heap gives to each shard."""
    taken = lambda t: [max(0, -((x - t) // size)) for x in loads]  # noqa: E731  of each shard's places that begin below t
    low, high = min(loads), min(loads) + size * count + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(taken(mid)) <= count else (low, mid)
    got = taken(low)
    left = count - sum(got)
    for j in [j for j, x in enumerate(loads) if x + got[j] * size == low][:left]:
        got[j] += 1
    return got


def schedule(sizes: Iterable[tuple[int, int]], shards: int = SHARDS) -> list[tuple[int, int, list[int], list[int]]]:
    """(size, groups, ends, shards) for (size, groups) in descending order of size: the size's groups numbered below
    ``ends[0]`` go to ``shards[0]``, the next ones below ``ends[1]`` to ``shards[1]``, and so on. Equal loads go to the lower shard."""
    heap = [(0, j) for j in range(shards)]
    out = []
    for size, count in sizes:
        if count > 4 * shards and size > 0:
            loads = [x for x, _ in sorted(heap, key=lambda h: h[1])]
            got = dict(enumerate(_level(loads, size, count)))
            heap = [(x + size * got[j], j) for j, x in enumerate(loads)]
            heapq.heapify(heap)
        else:
            got = {}
            for _ in range(count):
                load, j = heap[0]
                heapq.heapreplace(heap, (load + size, j))
                got[j] = got.get(j, 0) + 1
        ends, which, at = [], [], 0
        for j in sorted(j for j, n in got.items() if n):
            at += got[j]
            ends.append(at)
            which.append(j)
        out.append((size, count, ends, which))
    return out


def place(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, digest (of the text), shard and slot of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = cut_lineage(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
                                   F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest")), "shard-rows")
    groups = cut_lineage(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "shard-groups")
    counts = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).toArrow()  # at most sqrt(2 * bytes) rows
    c = sorted(zip(counts["bytes"].to_pylist(), counts["c"].to_pylist()), reverse=True)
    n_groups, n_rows = sum(x for _, x in c), sum(counts["n"].to_pylist())
    columns = list(zip(*schedule(c, shards))) or [[], [], [], []]
    table = pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())))],
                     names=["bytes", "c", "ends", "shards"])
    table = cut_lineage(spark.createDataFrame(table, "bytes long, c long, ends array<long>, shards array<int>"), "shard-schedule")
    numbered = global_row_number(groups, ["digest"], within=["bytes"], out="number", first=0)
    told = lookup(numbered, table, ["bytes"], "c", n_groups, F.col("digest"))
    shard = F.element_at("shards", F.size(F.filter("ends", lambda e: e <= F.col("number"))) + 1)
    told = cut_lineage(told.select("digest", "n", shard.alias("shard")), "shard-told")
    rows = lookup(rows, told, ["digest"], "n", n_rows, F.col("doc_id"))
    return global_row_number(rows, ["doc_id", "digest"], within=["shard"], out="slot", first=0)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """``docs`` as Parquet, a folder for each shard; rows with one id and text go where ``place`` puts them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    groups = cut_lineage(place(docs, shards, id_col, text_col).groupBy("digest", "shard").agg(F.count(F.lit(1)).alias("__n")), "shard-of-text")
    total = groups.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    own = docs.withColumn("digest", F.unhex(F.sha2(text, 256)))
    lookup(own, groups, ["digest"], "__n", total, F.col(id_col)).drop("digest").hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in 24 shards of nearly equal bytes; equal texts share a shard."""
    placed = place(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
