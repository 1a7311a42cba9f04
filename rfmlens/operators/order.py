"""Row numbers over all rows without a window over all rows (JN-7, FN-18).

``row_number().over(Window.orderBy(c))`` sends every row to one task, and a window partitioned by a key sends every row of
a hot key to one. Here the rows are range partitioned by (keys, order) and sorted inside the ranges, so a
row's place inside its range is known where it stands. One line for each (range, key) tells the rows before: at most
one line a key more than there are ranges. The number is the place inside the range, less the key's
first place there, plus the key's rows in the ranges before.

Rows that are equal in all keys and order columns stay in one range: order by enough columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rfmlens.session import cut_lineage

#: ``monotonically_increasing_id`` holds the partition above these bits and the row's place in it below.
PLACE_BITS = 33


def in_ranges(df: DataFrame, order: Sequence[str | Column], ranges: int | None = None, name: str = "ranges") -> DataFrame:
    """The rows range partitioned and sorted by ``order``, staged, with ``__p`` (range) and ``__i`` (place in it, from 0)."""
    n = max(1, int(ranges or df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.col("__at")
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    return cut_lineage(placed.select(*[F.col(f"`{c}`") for c in df.columns], F.shiftright(at, PLACE_BITS).cast("int").alias("__p"),
                                     at.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("__i")), name)


def global_row_number(df: DataFrame, order: Sequence[str | Column], within: Sequence[str] = (), out: str = "row_number",
                      first: int = 1, ranges: int | None = None) -> DataFrame:
    """``df`` with the number of each row in ``order``, counted from ``first``, for each value of the ``within`` columns.

    Columns of ``df`` must not begin with two underscores. Eager: the ranges are staged.
    """
    spark, within = df.sparkSession, list(within)
    placed = in_ranges(df, [*[F.col(f"`{c}`") for c in within], *order], ranges, "row_numbers")
    if not within:
        counts = sorted((r[0], int(r[1])) for r in placed.groupBy("__p").agg(F.count(F.lit(1))).collect())  # a row a range
        before = accumulate((n for _, n in counts), initial=0)
        offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "__q int, __before long")
        joined = placed.join(F.broadcast(offsets), F.col("__p") == F.col("__q"))
    else:
        keys = [F.col(f"`{c}`").alias(f"__key_{i}") for i, c in enumerate(within)]
        names = [f"__key_{i}" for i in range(len(within))]
        parts = placed.select(F.col("__p").alias("__q"), "__i", *keys).groupBy("__q", *names).agg(
            F.min("__i").alias("__first"), F.count(F.lit(1)).alias("__n"))
        earlier = Window.partitionBy(*names).orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
        offsets = cut_lineage(parts.select("__q", *names, (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__before")),
                              "row_offsets")
        same = F.col("__p") == F.col("__q")
        for c, k in zip(within, names):
            same = same & F.col(f"`{c}`").eqNullSafe(F.col(k))
        joined = placed.join(offsets, same)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__i") + F.col("__before") + F.lit(first)).alias(out))
