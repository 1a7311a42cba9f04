"""Sinks (SNK-1..7). The only functions in the library that act.

Single-file output (``coalesce(1)``) funnels all rows through one task; it is
opt-in and meant for small reports (histograms, distributions, profiles).
Per-segment outputs are one job with ``partitionBy``, not a loop of filters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rfmlens.operators.order import global_row_number


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists",
                  partition_by: Sequence[str] | None = None) -> None:
    """SNK-1/SNK-2: Parquet; ``mode='overwrite'`` with partitions replaces only
    the partitions present in ``df`` (dynamic partition overwrite).

    Partitioned rows are rebalanced by the partition columns first, so a
    partition is written by as many tasks as it has advisory partition sizes
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``), not by every task.
    """
    w = df.write.mode(mode)
    if partition_by:
        w = df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by)
        if mode == "overwrite":
            w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", header: bool = True,
              single_file: bool = False, partition_by: Sequence[str] | None = None) -> None:
    """SNK-3/4/5: CSV with header; ``single_file`` only for small reports."""
    out = df.coalesce(1) if single_file else df
    w = out.write.mode(mode).option("header", str(header).lower())
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_segments(df: DataFrame, path: str, segment: str = "cluster", key: str = "ifa",
                   mode: str = "errorifexists", fmt: str = "parquet",
                   label: str | None = None, files_per_segment: int | None = None,
                   rows_per_file: int | None = None) -> None:
    """SNK-6/SNK-7: one directory per segment (``segment=<id>``) in one job.

    Rows are distinct (segment, key) pairs; ``label`` renames the key column
    (the CSV header). By default the pairs are rebalanced, so a segment is
    written by as many tasks as it has advisory partition sizes.
    ``rows_per_file=n`` gives a segment of r rows exactly ceil(r / n) files:
    its pairs are numbered over ranges (``operators.order``) and every
    n of them in a row are a file. ``files_per_segment=n`` gives at most n
    files per segment, rows spread by a hash of the key; ``1`` reproduces the
    reference's single file per segment and funnels each segment through one
    task (small lists only).
    """
    pairs = df.select(segment, key).distinct()
    if rows_per_file:
        n = int(rows_per_file)
        numbered = global_row_number(pairs, [key], within=[segment], out="file", first=0)
        numbered = numbered.withColumn("file", F.floor(F.col("file") / F.lit(n)))
        # A task that holds several files of a segment has them in order, so all but the last are full: the writer cuts at n rows.
        # Small files cost their number, not their bytes: with a stated number of tasks they aren't merged into a few tasks by size.
        tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        pairs = numbered.repartition(tasks, segment, "file").sortWithinPartitions(segment, "file").drop("file")
    elif files_per_segment:
        salt = F.pmod(F.xxhash64(F.col(key)), F.lit(int(files_per_segment)))
        pairs = pairs.repartition(segment, salt) if files_per_segment > 1 else pairs.repartition(segment)
    else:
        pairs = pairs.hint("rebalance", segment)
    if label:
        pairs = pairs.withColumnRenamed(key, label)
    w = pairs.write.mode(mode).partitionBy(segment)
    if rows_per_file:
        w = w.option("maxRecordsPerFile", int(rows_per_file))
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.parquet(path)


def read_segments(spark, path: str, fmt: str = "parquet", segment: str = "cluster"):
    """Read back a ``write_segments`` output (segment restored as a column)."""
    if fmt == "csv":
        return spark.read.option("header", "true").csv(path)
    return spark.read.parquet(path)


def count_rows(df: DataFrame) -> int:
    """AGG-12: row count of a written or in-flight table."""
    return df.select(F.lit(1)).count()
