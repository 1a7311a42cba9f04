"""OP-13 data-quality checks (AGG-12, AGG-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def uniqueness_check(df: DataFrame, key: str = "ifa") -> DataFrame:
    """One row: rows, distinct keys (a null key counts as one value, like
    ``distinct().count()``), and whether they are equal.

    One aggregate job instead of the reference's two ``count`` actions.
    """
    has_null = F.max(F.col(key).isNull().cast("long"))
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  (F.countDistinct(key) + F.coalesce(has_null, F.lit(0).cast("long"))).alias("distinct_keys")
                  ).withColumn("is_unique", F.col("rows") == F.col("distinct_keys"))


def row_counts(**frames: DataFrame) -> dict[str, int]:
    """AGG-12: row counts of named frames (the reference's reconciliation prints)."""
    return {name: df.count() for name, df in frames.items()}


def row_reconciliation(before: DataFrame, after: DataFrame) -> DataFrame:
    """AGG-12: rows before and after a step (the reference prints both counts
    after clustering). One aggregate over both inputs, one row out."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    tagged = (before.select(one.alias("_in"), zero.alias("_out"))
              .unionByName(after.select(zero.alias("_in"), one.alias("_out"))))
    return (tagged.agg(F.sum("_in").alias("rows_in"), F.sum("_out").alias("rows_out"))
            .withColumn("rows_dropped", F.col("rows_in") - F.col("rows_out")))
