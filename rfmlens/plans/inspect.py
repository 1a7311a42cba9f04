"""Plan inspection through the public ``explain`` output.

Used by the tests to pin plan properties that matter at scale: no
``SinglePartition`` exchange, filters reaching the scan, pruned read schemas,
joins that are broadcast or absent.
"""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def exchanges(df: DataFrame) -> list[str]:
    """Partitioning of every shuffle exchange in the physical plan."""
    return re.findall(r"Exchange (\S+\(.*?\)|SinglePartition)", plan_text(df, "simple"))


def has_single_partition(df: DataFrame) -> bool:
    return "SinglePartition" in plan_text(df, "simple")


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*?)\]", plan_text(df, "formatted"))


def read_schemas(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: (struct<.*?>)", plan_text(df, "formatted"))


def partition_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PartitionFilters: \[(.*?)\]", plan_text(df, "formatted"))
