"""Usage operators: GEN-1, OP-1 (enrich), OP-2 (histogram), OP-7 (daily use).

The reference joins the userbase (several connection rows per device) to the
exploded usage rows on the device id, a many-to-many join that repeats every
usage row once per userbase row, and then aggregates the result. At scale that
join emits all pairs inside each device, which a hot device turns into one
enormous task. Both consumers only need per-device *counts* of userbase rows,
so we aggregate each side to the device first and join 1:1 on the key:

* daily use: sum over (userbase rows with an allowed channel) x (usage rows of
  the day) = eligible_rows(device) * sum(brq_count of the day);
* histogram: the distinct (device, count) pairs of devices that have at least
  one userbase row (a semi join).

The results are identical to the pair-emitting form (checked against it in
the SQL oracle and in the tests).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rfmlens.config import REFERENCE_DAILY_EXCLUDED
from rfmlens.functions.dates import days_before, month_start, months_before, usage_day
from rfmlens.functions.scalar import channel_allowed
from rfmlens.operators.skew import join_per_key
from rfmlens.session import cut_lineage


def explode_apps(usage: DataFrame, key: str = "ifa", array_col: str = "app",
                 fields: Sequence[str] | None = ("last_seen", "brq_count"),
                 keep: Sequence[str] = ()) -> DataFrame:
    """GEN-1 + PRJ-2/3: one row per array element; empty or null arrays drop
    the row. ``fields=None`` expands every struct field (``col.*``)."""
    exploded = usage.select(key, *keep, F.explode(array_col).alias("col"))
    if fields is None:
        return exploded.select(key, *keep, "col.*")
    return exploded.select(key, *keep, *[F.col(f"col.{f}").alias(f) for f in fields])


#: Pairs of an app and a connection that one task groups; nearly all are groups of their own.
PAIRS_PER_TASK = 500_000


def cross_counts(usage: DataFrame, key: str = "ifa", month: str = "month", app: str = "app",
                 connection: str = "connection", channel: str = "req_con_type_desc",
                 pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """GEN-2 as written: every app of a record with every connection of it, counted per device, month, app and channel.

    The pairs are many times the bytes of the records, and hardly any share a group. So the records move, not the
    pairs, and over as many tasks as the number of pairs asks for: a task holds the groups of about ``pairs_per_task``
    pairs whatever the size of the table or the session's partitions. Eager: the records are staged and their pairs
    counted from the array sizes. A device's month lies in one task, which keeps its groups, not its pairs.
    """
    records = cut_lineage(usage.select(key, month, app, connection), "cross_records")
    n_of = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long")  # noqa: E731 -- none for a null array
    pairs = records.agg(F.sum(n_of(app) * n_of(connection))).first()[0] or 0
    dealt = records.repartition(max(1, -(-int(pairs) // pairs_per_task)), key, month)
    crossed = dealt.select(key, month, connection, F.explode(app).alias("a")).select(
        key, month, "a.bundle", "a.brq_count", F.explode(connection).alias("c"))
    return crossed.groupBy(key, month, "bundle", F.col(f"c.{channel}").alias(channel)).agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("brq_count").alias("brq"))


def with_usage_dates(events: DataFrame, anchor_day: dt.date, ts: str = "last_seen") -> DataFrame:
    """FN-1..4: day, month start, months and days before the anchors."""
    anchor_month = anchor_day.replace(day=1)
    return (events
            .withColumn("date", usage_day(ts))
            .withColumn("month", month_start("date"))
            .withColumn("period_months", months_before(anchor_month, "month"))
            .withColumn("days_since", days_before(anchor_day, "date")))


def channel_links(userbase: DataFrame, key: str = "ifa", channel: str = "req_con_type_desc",
                  excluded: Sequence[str] | None = None, name: str = "links") -> DataFrame:
    """Userbase rows per device; with ``excluded`` only rows whose channel is allowed."""
    rows = userbase if excluded is None else userbase.where(channel_allowed(channel, excluded))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def enrich_usage(events: DataFrame, userbase: DataFrame, anchor_day: dt.date,
                 key: str = "ifa") -> DataFrame:
    """OP-1: usage rows of userbase devices with the date columns.

    ``ub_rows`` is the number of userbase rows of the device, i.e. how often
    the reference's many-to-many join repeats the row; joining this frame to
    the userbase on ``key`` gives the reference's ``main_df`` row for row.
    The output keeps every usage row, so devices that hold a large share of
    the rows are joined map-side (``operators.skew``); one keys-only counting
    job finds them.
    """
    links = channel_links(userbase, key, name="ub_rows")
    joined = join_per_key(events, links, key, "inner")
    return with_usage_dates(joined, anchor_day)


def enriched_daily_summary(enriched: DataFrame, key: str = "ifa") -> DataFrame:
    """Per device-day totals of the enriched usage as the pair form would count them."""
    return (enriched.groupBy(key, "date", "month", "period_months", "days_since")
            .agg(F.sum("ub_rows").alias("main_rows"),
                 F.sum(F.col("brq_count") * F.col("ub_rows")).alias("main_brq")))


def usage_histogram(events: DataFrame, userbase: DataFrame, key: str = "ifa",
                    count_col: str = "brq_count", count_name: str = "ifa_count") -> DataFrame:
    """OP-2: devices per total usage, over distinct (device, count) pairs.

    The distinct is map-side combined before the shuffle, so a hot device
    contributes at most one row per distinct count value. ``count_name``
    names the device count (the reference's report calls it ``ifa``).
    """
    pairs = events.select(key, count_col).distinct()
    known = userbase.select(key).distinct()
    totals = (pairs.join(known, key, "left_semi")
              .groupBy(key).agg(F.sum(count_col).alias("sum_brq")))
    return (totals.groupBy("sum_brq").agg(F.count(key).alias(count_name))
            .orderBy("sum_brq"))


def daily_usage(events: DataFrame, userbase: DataFrame, anchor_day: dt.date,
                excluded: Sequence[str] = REFERENCE_DAILY_EXCLUDED, key: str = "ifa",
                channel: str = "req_con_type_desc", count_col: str = "brq_count",
                dedupe_channels: bool = False) -> DataFrame:
    """OP-7: usage per device and day over the allowed-channel userbase rows.

    Grouped first at (device, day) -- partial aggregation before the shuffle,
    and a hot device is spread over its days -- then joined 1:1 to the
    per-device count of allowed userbase rows. As in the reference, a day's
    usage counts once per allowed userbase row (SURVEY T1);
    ``dedupe_channels=True`` counts it once for any device with at least one.
    """
    per_day = (events.withColumn("date", usage_day("last_seen"))
               .groupBy(key, "date").agg(F.sum(count_col).alias("_day_sum")))
    return daily_from_day_sums(per_day, userbase, anchor_day, excluded, key, channel, dedupe_channels)


def daily_from_day_sums(per_day: DataFrame, userbase: DataFrame, anchor_day: dt.date,
                        excluded: Sequence[str] = REFERENCE_DAILY_EXCLUDED, key: str = "ifa",
                        channel: str = "req_con_type_desc", dedupe_channels: bool = False) -> DataFrame:
    """OP-7 second half: (key, date, _day_sum) x allowed userbase rows per key."""
    anchor_month = anchor_day.replace(day=1)
    links = channel_links(userbase, key, channel, excluded, name="_links")
    if dedupe_channels:
        links = links.select(key, F.lit(1).cast("long").alias("_links"))
    return (per_day.join(links, key, "inner")
            .select(key, "date",
                    months_before(anchor_month, month_start("date")).alias("period_months"),
                    days_before(anchor_day, "date").alias("days_since"),
                    (F.col("_day_sum") * F.col("_links")).alias("sum_brq_daily")))
