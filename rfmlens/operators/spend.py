"""Spend operators: OP-4 latest device, OP-5 category usage, OP-6 monthly spend,
OP-9 peak spend (EXT-3: the month is a key column, not a driver loop)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rfmlens.config import REFERENCE_FX_RATE, REFERENCE_SPEND_EXCLUDED
from rfmlens.functions.scalar import converted_price, try_double
from rfmlens.operators.taxonomy import sized
from rfmlens.operators.topk import top1_per_key


def latest_device(devices: DataFrame, keys: Sequence[str] = ("ifa", "month"),
                  order_by: Sequence[str] = ("snapshot_ts", "record_id")) -> DataFrame:
    """OP-4 / WIN-1: the latest device record per device (and month).

    ``order_by`` is the explicit tie-break the reference lacks.
    """
    return top1_per_key(devices, keys, order_by, descending=True)


def priced_devices(latest: DataFrame, fx_rate: float = REFERENCE_FX_RATE, key: str = "ifa",
                   month: str | None = "month", price: str = "device.price") -> DataFrame:
    """OP-4 tail (PRJ-2, FLT-2, FN-8): devices with a non-zero price, converted.

    The price is read as a number (``'0'``, ``'0.0'`` and ``0.0`` are all
    zero); null or unparsable prices are dropped like the reference's
    ``!= '0.0'`` drops nulls.
    """
    p = try_double(F.col(price))
    keys = [key] + ([month] if month else [])
    return (latest.where(p != F.lit(0.0))
            .select(*keys, converted_price(p, fx_rate).alias("myr_price")))


def latest_prices(devices: DataFrame, fx_rate: float = REFERENCE_FX_RATE, keys: Sequence[str] = ("ifa", "month"),
                  order_by: Sequence[str] = ("snapshot_ts", "record_id"),
                  price: str = "device.price") -> DataFrame:
    """OP-4 end to end: latest record per key, then its non-zero converted price.

    Only the keys, the ordering columns and the price enter the aggregate, so
    the scan reads just those (the aggregate hides struct fields from nested
    column pruning). The zero-price filter runs after the pick, as in the
    reference: a latest record without a price drops the device for that
    month rather than falling back to an older record.
    """
    slim = devices.select(*keys, *order_by, F.struct(F.col(price).alias("price")).alias("device"))
    latest = top1_per_key(slim, keys, order_by, descending=True)
    month = keys[1] if len(keys) > 1 else None
    return priced_devices(latest, fx_rate, keys[0], month)


def category_usage(usage: DataFrame, taxonomy: DataFrame, category: str,
                   category_col: str = "app_l1_name", excluded: Sequence[str] = REFERENCE_SPEND_EXCLUDED,
                   key: str = "ifa", month: str | None = "month", app: str = "app",
                   connection: str = "connection", channel: str = "req_con_type_desc") -> DataFrame:
    """OP-5 (GEN-2, JN-4, FLT-1, FLT-4, AGG-3): usage of one app category on data.

    The reference explodes apps and connections of each record into their
    cross product and keeps the pairs with an allowed channel, so every app
    counts once per allowed connection of its record. We count the allowed
    connections per record with a higher-order ``filter`` and weight the
    app's count by it: the same sum without emitting the pairs.

    The category filter rejects apps without a category, so the reference's
    left join becomes an inner join against the category's bundles. That list
    is staged (``taxonomy.sized``), so the planner knows its bytes: below the
    session's broadcast threshold the usage rows never move; beyond it both
    sides are plain shuffles, where AQE splits a popular app's partition.
    """
    keys = [key] + ([month] if month else [])
    allowed = F.filter(F.col(connection),
                       lambda c: c[channel].isNotNull() & ~c[channel].isin(list(excluded)))
    weight = F.when(F.col(connection).isNull(), F.lit(0)).otherwise(F.size(allowed))
    apps = (usage.select(*keys, weight.alias("_w"), F.explode(app).alias("_a"))
            .where(F.col("_w") > 0)
            .select(*keys, F.col("_a.bundle").alias("bundle"),
                    F.col("_a.brq_count").alias("brq_count"), "_w"))
    bundles = taxonomy.where(F.col(category_col) == F.lit(category)).select("bundle")
    joined = apps.join(sized(bundles, "category_bundles"), "bundle", "inner")
    return (joined
            .groupBy(*keys)
            .agg(F.sum(F.col("brq_count") * F.col("_w")).alias("data_streaming")))


def monthly_spend(priced: DataFrame, streaming: DataFrame, key: str = "ifa",
                  month: str | None = "month", how: str = "inner") -> DataFrame:
    """OP-6 (JN-5, FN-9): device price + category usage, for devices with both.

    ``how`` widens the population (SURVEY T4); a missing side gives a null
    spend, as ``+`` with null does.
    """
    keys = [key] + ([month] if month else [])
    return (priced.join(streaming, keys, how)
            .select(*keys, (F.col("myr_price") + F.col("data_streaming")).alias("spend")))


def peak_spend(spend: DataFrame, key: str = "ifa") -> DataFrame:
    """OP-9 / WIN-2: highest monthly spend per device.

    Only the value is kept, so top-1-by-spend is ``max(spend)`` (nulls lose,
    as with ``NULLS LAST``; a device whose spends are all null keeps null).
    """
    return spend.groupBy(key).agg(F.max("spend").alias("spend"))
