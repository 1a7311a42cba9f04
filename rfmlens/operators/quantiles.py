"""Exact quantiles per group at any size (AGG-10, JN-10).

``percentile`` keeps all values of a group in one state, ``percentile_approx`` a sketch that is exact up to its accuracy. A quantile is an order
statistic: the value below or at which lie ``ceil(q * n)`` of the group's n values. So it is selected in three steps, none of
which brings a group together:

1. the histogram of (group, column, value), map-side combined, range partitioned by these and staged;
2. totals per range, one line for each (group, column) and range, give the rows before each range and with them the one range that
   holds the element asked for;
3. a running sum inside that range picks the element.

All columns and quantiles share the passes. Nulls are left out and NaN is above every number, as in Spark's own aggregates; a null group is a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rfmlens.functions.scalar import try_double
from rfmlens.operators.order import in_ranges
from rfmlens.session import cut_lineage


def exact_quantiles(df: DataFrame, columns: Sequence[str], by: str, quantiles: Sequence[float] = (0.5,),
                    names: Sequence[str] = ("median",), ranges: int | None = None) -> DataFrame:
    """One row for each value of ``by``: ``<name>_<column>`` for every quantile and column, as doubles.

    Each is an element of the data, for an even count the lower middle at 0.5 (SQL's ``percentile_disc``). A group without
    a value in a column has null there; a group without any value in all columns keeps its row. Eager: the histogram is staged.
    """
    if len(quantiles) != len(names):
        raise ValueError("one name for each quantile")
    cells = [F.struct(F.lit(i).alias("c"), try_double(F.col(f"`{c}`")).alias("v")) for i, c in enumerate(columns)]
    group = F.col(f"`{by}`").alias("g")
    long = df.select(group, F.explode(F.array(*cells)).alias("x")).select("g", "x.c", "x.v")
    histogram = long.groupBy("g", "c", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = in_ranges(histogram, ["g", "c", F.col("v").asc_nulls_first()], ranges, "quantile_values")
    valued = placed.where(F.col("v").isNotNull())

    whole = Window.partitionBy("g", "c")
    before = F.coalesce(F.sum("m").over(whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = valued.groupBy("g", "c", "__p").agg(F.sum("n").alias("m")).select(
        "g", "c", "__p", "m", before.alias("before"), F.sum("m").over(whole).alias("total"))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), F.greatest(F.ceil(F.lit(float(q)) * F.col("total")), F.lit(1)).alias("rank"))
                                 for i, q in enumerate(quantiles)]))
    at = totals.select("*", wanted.alias("w")).where((F.col("w.rank") > F.col("before")) & (F.col("w.rank") <= F.col("before") + F.col("m")))
    at = cut_lineage(at.select(F.col("g").alias("_g"), F.col("c").alias("_c"), F.col("__p").alias("_p"), "before", "w.q", "w.rank"), "quantile_ranges")

    # one range of one group at a time, once for each quantile that lies in it
    found = valued.join(at, F.col("g").eqNullSafe(F.col("_g")) & (F.col("c") == F.col("_c")) & (F.col("__p") == F.col("_p")))
    inside = Window.partitionBy("g", "c", "q").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("n").over(inside)
    picked = found.select("g", "c", "q", "v", "n", "rank", upto.alias("upto")).where(
        (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
    cell = lambda i, j: F.max(F.when((F.col("c") == i) & (F.col("q") == j), F.col("v")))
    every = placed.select("g").distinct().select("g", F.lit(None).cast("int").alias("c"), F.lit(None).cast("int").alias("q"),
                                                 F.lit(None).cast("double").alias("v"))
    return every.unionByName(picked.select("g", "c", "q", "v")).groupBy(F.col("g").alias(by)).agg(
        *[cell(i, j).alias(f"{names[j]}_{c}") for i, c in enumerate(columns) for j in range(len(quantiles))])
