"""TOP-1 per key (WIN-1, WIN-2) as an aggregate.

``row_number().over(partitionBy(k).orderBy(o.desc())) == 1`` keeps one row per
key. ``max_by(payload, ordering)`` computes the same row with a hash aggregate:
the partial aggregate runs before the shuffle, so a key holding a third of
all rows sends one row per map task, not all of its rows, to one reducer.
The ordering is a struct, compared field by field (struct buffers make it a
sort-based aggregate, partial and final, so it spills instead of failing on
large groups); ties on every ordering field must be broken by the caller (the reference's monthly device files tie
on the month for every row of a device, so the pick there is arbitrary).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top1_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                 descending: bool = True, payload: Sequence[str] | None = None) -> DataFrame:
    """One row per ``keys``: the row with the largest (or smallest) ``order_by``.

    Null ordering fields sort as in the window form (``NULLS LAST`` when
    descending, ``NULLS FIRST`` when ascending).
    """
    keys = list(keys)
    payload = [c for c in (payload if payload is not None else df.columns) if c not in keys]
    order = F.struct(*[F.col(f"`{c}`") for c in order_by])
    body = F.struct(*[F.col(f"`{c}`") for c in payload])
    # Struct comparison puts null fields first, so max_by matches a descending
    # window's NULLS LAST and min_by an ascending window's NULLS FIRST.
    pick = F.max_by(body, order) if descending else F.min_by(body, order)
    return (df.groupBy(*keys).agg(pick.alias("__top"))
            .select(*keys, *[F.col("__top").getField(c).alias(c) for c in payload]))
