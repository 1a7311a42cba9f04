"""Audience lists (OP-20, OP-21): device ids per segment and overall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rfmlens.sources.sinks import write_segments


def audience_lists(model: DataFrame, cluster: str = "cluster", key: str = "ifa",
                   drop_null_ids: bool = False) -> DataFrame:
    """OP-20 (AGG-14): distinct (segment, device) pairs, every segment at once.

    The reference filters one literal cluster name at a time; the segments
    here come from the data. A null id stays, as in the reference's
    ``distinct()``, unless ``drop_null_ids``; lists and exports agree.
    """
    rows = model.where(F.col(key).isNotNull()) if drop_null_ids else model
    return rows.select(cluster, key).distinct()


def audience_all(model: DataFrame, key: str = "ifa", drop_null_ids: bool = False) -> DataFrame:
    """OP-20 (AGG-14): the overall distinct device list."""
    rows = model.where(F.col(key).isNotNull()) if drop_null_ids else model
    return rows.select(key).distinct()


def audience_sizes(lists: DataFrame, cluster: str = "cluster", key: str = "ifa") -> DataFrame:
    """AGG-12 per segment: the counts the reference prints before each write."""
    return lists.groupBy(cluster).agg(F.count(key).alias("ifa_count"))


def export_audiences(model: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                     cluster: str = "cluster", key: str = "ifa", label: str | None = None,
                     files_per_segment: int | None = None, drop_null_ids: bool = False,
                     rows_per_file: int | None = None) -> None:
    """OP-20/OP-21 (SNK-2, SNK-6, SNK-7): one directory per segment, one job.

    For CSV, ``label`` is the header of the id column (the reference uses
    ``Mobile Device ID``). ``rows_per_file`` gives files of that many ids;
    ``files_per_segment=1`` gives the reference's one file per segment; see
    ``write_segments`` for the cost of that.
    """
    write_segments(model.where(F.col(key).isNotNull()) if drop_null_ids else model, path, segment=cluster, key=key, mode=mode, fmt=fmt, label=label,
                   files_per_segment=files_per_segment, rows_per_file=rows_per_file)


def key_sketches(df: DataFrame, by: Sequence[str], key: str = "ifa", lg: int = 14) -> DataFrame:
    """AGG-1, AGG-6, AGG-13 mergeable: a HyperLogLog sketch of the distinct keys of each group (Spark's built-in), as one small
    binary column that can be stored by month and merged later; the exact counts need all keys again."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(key, F.lit(lg)).alias("keys"))


def merged_counts(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Estimated distinct keys (``n_keys``) of each coarser group, from the stored sketches alone."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("keys")).alias("n_keys"))
