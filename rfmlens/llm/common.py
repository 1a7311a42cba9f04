"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rfmlens.session import cut_lineage, stage_path

__all__ = ["HOT_SHARE", "cut_lineage", "fold", "lookup", "shared_code", "stage_path", "unused", "words"]

#: A key is hot when it holds more than 1 / HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_code(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``run`` after the Python workers were told where this package is, for sessions that were started elsewhere.

    Executors on other machines need the package installed or given by ``--py-files``, as any Python code on Spark.
    """
    def told(spark: SparkSession, sf_dir: str) -> DataFrame:
        root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            env["PYTHONPATH"] = os.pathsep.join([*paths, root])
        return run(spark, sf_dir)

    return told


def fold(text: Column) -> Column:
    """Lower-case A-Z only; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of the folded text (an empty array where it has none)."""
    return F.filter(F.split(fold(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], n: str, total: int, spread: Column) -> DataFrame:
    """Left join of ``right``, which has one row per key, without putting a hot key into one task.

    ``right[n]`` counts the rows of ``left`` that hold the key and ``total`` all rows of ``left``. Keys with
    more than ``total / HOT_SHARE`` rows number fewer than HOT_SHARE, so their rows of ``right`` are broadcast.
    The other keys are joined by an ordinary shuffle, in which the rows of hot (and null) keys are dealt
    out by ``spread`` and match nothing. ``right`` is read twice: pass a staged table.
    """
    keys = list(keys)
    values = [c for c in right.columns if c not in (*keys, n)]
    is_hot = F.col(n) * HOT_SHARE > F.lit(total)
    hot = right.where(is_hot).select(*keys, *[F.col(c).alias(f"__hot_{c}") for c in values], F.lit(True).alias("__hot"))
    cold = right.where(~is_hot).select(*keys, *[F.col(c).alias(f"__cold_{c}") for c in values],
                                       F.lit(0).cast("long").alias("__salt"))
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn(
        "__salt", F.when(F.col("__hot").isNotNull() | no_key, F.xxhash64(spread, F.lit(1))).otherwise(F.lit(0).cast("long")))
    return dealt.join(cold, [*keys, "__salt"], "left").select(
        *[F.col(c) for c in left.columns], *[F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in values])
