"""Hot keys in row-level joins.

Aggregations here combine map-side, so a key holding a third of all rows
costs nothing special. A join that must keep every row of the large side
(one row per key on the other side) does not: all rows of a hot key meet in
one task. AQE's skew join does not help when the small side is the result of
an aggregate (its rule needs both inputs to be plain shuffles), which is the
usual case here. So the small side carries the number of rows that the large
side has for each key, and the join is split by it:

* a key is hot when it holds more than 1/``HOT_SHARE`` of the large side's
  rows. There are fewer than ``HOT_SHARE`` such keys whatever the size of the
  data, so their rows of the small side are broadcast and joined map-side;
* every other key has at most 1/``HOT_SHARE`` of the rows and is joined by the
  ordinary shuffle. The rows of hot keys pass through that shuffle too (so
  the large side is read once) but are dealt out by a hash of the whole row.

No key list is collected, nothing is cut off, and the rule does not depend on
an absolute size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rfmlens.session import cut_lineage

# A key is hot above 1/HOT_SHARE of the rows.
HOT_SHARE = 1000


def join_counted(big: DataFrame, small: DataFrame, key: str, count: str, total: int,
                 how: str = "inner", null_safe: bool = False, hot_share: int = HOT_SHARE) -> DataFrame:
    """``big.join(small, key, how)`` for ``small`` with one row per key.

    ``small[count]`` is the key's number of rows in ``big`` and ``total`` their
    sum (at least the rows of all keys of ``small``); the column is not part of the result.
    ``how`` is ``inner`` or ``left``; ``null_safe`` lets a null key match a null
    key. ``small`` is read twice: pass a staged table.
    """
    if how not in ("inner", "left"):
        raise ValueError("join_counted keeps the large side's rows: how must be inner or left")
    values = [c for c in small.columns if c not in (key, count)]
    is_hot = F.col(count) * F.lit(hot_share) > F.lit(total)

    def side(rows: DataFrame, tag: str) -> DataFrame:
        return rows.select(F.col(f"`{key}`").alias(f"__{tag}_key"), F.lit(True).alias(f"__{tag}"),
                           *[F.col(f"`{c}`").alias(f"__{tag}_{c}") for c in values])

    def same(tag: str):
        k = F.col(f"__{tag}_key")
        return F.col(f"`{key}`").eqNullSafe(k) if null_safe else F.col(f"`{key}`") == k

    marked = big.join(F.broadcast(side(small.where(is_hot), "hot")), same("hot"), "left")
    no_match = F.col("__hot").isNotNull()
    if not null_safe:
        no_match = no_match | F.col(f"`{key}`").isNull()
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in big.columns], F.lit(1))
    marked = marked.withColumn("__salt", F.when(no_match, spread).otherwise(F.lit(0).cast("long")))
    cold = side(small.where(~is_hot), "cold").withColumn("__cold_salt", F.lit(0).cast("long"))
    out = marked.join(cold, same("cold") & (F.col("__salt") == F.col("__cold_salt")), "left")
    if how == "inner":
        out = out.where(F.col("__hot").isNotNull() | F.col("__cold").isNotNull())
    return out.select(*[F.col(f"`{c}`") for c in big.columns],
                      *[F.coalesce(f"`__hot_{c}`", f"`__cold_{c}`").alias(c) for c in values])


def join_per_key(big: DataFrame, small: DataFrame, key: str, how: str = "inner",
                 hot_share: int = HOT_SHARE) -> DataFrame:
    """``big.join(small, key, how)`` where ``small`` has one row per key, safe
    for hot keys of ``big`` (see module docstring). One keys-only aggregate of
    ``big`` counts its rows per key; the counted small side is staged."""
    counts = big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    counted = cut_lineage(small.join(counts, key, "inner"), "counted")
    total = counted.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    return join_counted(big, counted, key, "__n", total, how, hot_share=hot_share)
