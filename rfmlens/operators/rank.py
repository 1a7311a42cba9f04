"""EXT-1: global ``percent_rank`` without a single-partition window.

``percent_rank().over(Window.orderBy(c))`` has no partition key, so Spark moves
every row into one task. The value of a row only depends on how many rows sort
strictly before its value:

    pct(v) = below(v) / (N - 1),   N = 1 -> 0.0

so the job is a histogram problem, solved in one way for every type and size:

1. the histogram ``groupBy(v).count()``, map-side combined, so a hot value is
   one row from here on;
2. its rows are range partitioned on the full value (Spark samples the bounds),
   which gives ranges of about the same number of distinct values, and staged
   with their range number;
3. the totals per range, one number for each, become the offsets of the
   ranges, and a running sum inside each range gives ``below`` for each value;
4. the ranked values are joined back to the rows. Each value knows its number
   of rows, so hot values are joined map-side and all others by a shuffle
   (``operators.skew.join_counted``); Spark broadcasts the whole table if its
   size is below the session's threshold.

Null placement follows Spark: ascending puts nulls first, descending last; NaN
is above every number, and -0.0 equals 0.0. Ties share the lowest rank, as in
``percent_rank``.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rfmlens.operators.skew import join_counted
from rfmlens.session import cut_lineage


@dataclass(frozen=True)
class RankSpec:
    """One percent rank. ``keep_nulls`` ranks nulls as Spark's window does
    (first ascending, last descending, counted in N); without it null rows get
    a null rank and N counts the non-null rows only."""

    column: str
    descending: bool = False
    output: str | None = None
    keep_nulls: bool = True

    @property
    def out(self) -> str:
        return self.output or f"{self.column}_percentile"


def value_counts(df: DataFrame, spec: RankSpec) -> DataFrame:
    """The histogram that a rank needs: (value ``__v``, rows ``__c``), map-side combined."""
    values = df.select(F.col(f"`{spec.column}`").alias("__v"))
    if not spec.keep_nulls:
        values = values.where(F.col("__v").isNotNull())
    return values.groupBy("__v").agg(F.count(F.lit(1)).alias("__c"))


def changed_counts(counts: DataFrame, gone: DataFrame, come: DataFrame, spec: RankSpec) -> DataFrame:
    """The histogram after the rows ``gone`` left and the rows ``come`` were added: signed counts of the changed rows are merged
    into the stored ones, so a refresh reads the histogram and the change, never the unchanged rows."""
    change = value_counts(come, spec).unionByName(value_counts(gone, spec).select("__v", (-F.col("__c")).alias("__c")))
    return counts.select("__v", "__c").unionByName(change).groupBy("__v").agg(F.sum("__c").alias("__c")).where(F.col("__c") != 0)


def ranked_counts(counts: DataFrame, spec: RankSpec, ranges: int) -> tuple[DataFrame, int]:
    """(value, count, rank) of every distinct value of a histogram, and the number of ranked rows."""
    order = F.col("__v").desc_nulls_last() if spec.descending else F.col("__v").asc_nulls_first()
    placed = cut_lineage(counts.repartitionByRange(ranges, order).withColumn("__p", F.spark_partition_id()), "rank_values")
    totals = sorted((r[0], int(r[1])) for r in placed.groupBy("__p").agg(F.sum("__c")).collect())  # <= ranges rows
    ends = list(accumulate(c for _, c in totals))
    n = ends[-1] if ends else 0
    offsets = counts.sparkSession.createDataFrame([(p, e - c) for (p, c), e in zip(totals, ends)], "__p int, __o long")
    before = Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("__c").over(before), F.lit(0)) + F.col("__o")
    pct = below.cast("double") / F.lit(float(n - 1)) if n > 1 else F.lit(0.0)
    return placed.join(F.broadcast(offsets), "__p").select("__v", "__c", pct.alias(spec.out)), n


def ranks_from_counts(df: DataFrame, stored: Sequence[tuple[RankSpec, DataFrame]], buckets: int | None = None) -> DataFrame:
    """Percent ranks of the rows of ``df`` among the rows that the stored histograms count (``df`` itself, or any part of them)."""
    ranges = max(1, int(buckets or df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    with ThreadPoolExecutor(max_workers=min(4, max(1, len(stored)))) as pool:
        ranked = list(pool.map(lambda x: ranked_counts(x[1], x[0], ranges), stored))
    out = df
    for (s, _), (values, n) in zip(stored, ranked):
        values = values.withColumnRenamed("__v", s.column)
        out = join_counted(out, values, s.column, "__c", n, how="left", null_safe=s.keep_nulls)
    return out


def percent_ranks(
    df: DataFrame,
    specs: Sequence[RankSpec | tuple],
    *,
    buckets: int | None = None,
) -> DataFrame:
    """Add one ``percent_rank`` column per spec, computed without SinglePartition.

    Stages one histogram per spec (the specs' jobs run at the same time);
    persist or stage ``df`` first when it is expensive to recompute.
    ``buckets`` is the number of ranges, by default the session's shuffle
    partitions.
    """
    specs = [s if isinstance(s, RankSpec) else RankSpec(*s) for s in specs]
    if not specs:
        return df
    return ranks_from_counts(df, [(s, value_counts(df, s)) for s in specs], buckets)


def percent_rank_window(df: DataFrame, column: str, descending: bool = False, output: str | None = None) -> DataFrame:
    """WIN-3..6 as written in the reference (one global window, single task).

    Kept for small inputs and as the equality reference for ``percent_ranks``.
    """
    v = F.col(column)
    w = Window.orderBy(v.desc() if descending else v.asc())
    return df.withColumn(output or f"{column}_percentile", F.percent_rank().over(w))
