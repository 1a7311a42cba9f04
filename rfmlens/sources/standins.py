"""Role mapping of the shared test tables onto the scoring job's inputs.

The test tables (``orders``, ``lineitem``, ``customer``, ``supplier``,
``nation``, ``region``, ``events``) carry no device data; these adapters give
them the shapes of the real inputs (see FIXTURES.md) so that every query runs
the real operators over whole tables. Everything here is a Spark plan over
the given tables; nothing is collected.

| role                              | stand-in                                      |
| --------------------------------- | --------------------------------------------- |
| device id ``ifa``                 | ``o_custkey``                                  |
| userbase row (several per device) | distinct (custkey, orderpriority, orderstatus) |
| connection type / WIFI / Unknown  | ``o_orderpriority`` / 5-LOW / 4-NOT SPECIFIED  |
| nested usage record               | one per order: app = its line items (supplier, |
|                                   | order date, quantity), connection = [priority, |
|                                   | a channel by status]; and one per customer     |
|                                   | whose app array is null or empty               |
| device snapshot (price)           | order: status, priority, total price as text  |
|                                   | (some null, zero or not a number)             |
| app master -> level -> lifestage  | supplier -> nation -> region; suppliers in     |
|                                   | debt have no level                            |
| streaming category                | ``lifestage_name = 'AMERICA'``                 |
| age class 0..3 (4 = unmapped)     | ``pmod(c_nationkey, 5)``                       |
| app category counts               | ``events`` per user and event type            |
| place counts                      | line items per customer and return flag       |
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rfmlens.config import REFERENCE_FX_RATE, ScoringConfig
from rfmlens.operators.spend import latest_prices
from rfmlens.operators.usage import explode_apps

# Fixed values of the role mapping (test tables -> reference roles).
STANDIN_CONFIG = ScoringConfig(
    anchor_day=dt.date(2001, 8, 31),
    daily_excluded=("5-LOW",),
    spend_excluded=("5-LOW", "4-NOT SPECIFIED"),
    category_col="lifestage_name",
    category="AMERICA",
    fx_rate=REFERENCE_FX_RATE,
    scale=5.0,
)
APP_CATEGORIES = ("click", "error", "purchase", "signup", "view")
# Return flags A/N/R, prefixed: Spark resolves names case-insensitively and
# "r" is already the recency score.
PLACE_CODES = ("RF_A", "RF_N", "RF_R")
AGE_CLASSES = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def userbase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "orders")
            .select(F.col("o_custkey").alias("ifa"),
                    F.col("o_orderpriority").alias("req_con_type_desc"),
                    F.col("o_orderstatus").alias("req_carrier_name"))
            .distinct())


def second_channel() -> Column:
    """The second connection of an order's record: allowed, excluded or null."""
    return F.when(F.col("o_orderstatus") == "F", "1-URGENT").when(F.col("o_orderstatus") == "O", "5-LOW")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested monthly usage records: ifa, app array, connection array, month.

    An order has a handful of line items, so its arrays are small.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    lines = (table(spark, sf_dir, "lineitem")
             .groupBy(F.col("l_orderkey").alias("o_orderkey"))
             .agg(F.collect_list(F.struct(F.col("l_suppkey").alias("bundle"),
                                          F.col("l_quantity").cast("bigint").alias("brq_count"))).alias("lines")))
    channel = lambda c: F.struct(c.alias("req_con_type_desc"))
    app = F.transform("lines", lambda x: F.struct(x["bundle"].alias("bundle"), F.col("o_orderdate").alias("last_seen"),
                                                  x["brq_count"].alias("brq_count")))
    records = o.join(lines, "o_orderkey", "left").select(
        F.col("o_custkey").alias("ifa"), app.alias("app"),
        F.array(channel(F.col("o_orderpriority")), channel(second_channel())).alias("connection"),
        F.date_format("o_orderdate", "yyyyMM").alias("month"))
    app_type = records.schema["app"].dataType
    idle = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ifa"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None)).otherwise(F.array()).cast(app_type).alias("app"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(None)).otherwise(
            F.array(channel(F.lit("1-URGENT")))).alias("connection"),
        F.lit("200108").alias("month"))
    return records.unionByName(idle)


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_apps(usage(spark, sf_dir))


def price_text() -> Column:
    """Prices as text: of some orders null, zero or not a number."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return (F.when(status == "P", "n/a")
            .when((status == "O") & (priority == "3-MEDIUM"), "0")
            .when((status == "O") & (priority == "2-HIGH"), F.lit(None))
            .otherwise(F.col("o_totalprice").cast("string")))


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly device snapshots with an explicit tie-break (record id)."""
    return (table(spark, sf_dir, "orders")
            .select(F.col("o_custkey").alias("ifa"),
                    F.struct(F.col("o_orderstatus").alias("device_name"),
                             F.col("o_orderpriority").alias("device_model"),
                             price_text().alias("price")).alias("device"),
                    F.date_format("o_orderdate", "yyyyMM").alias("month"),
                    F.col("o_orderdate").alias("snapshot_ts"),
                    F.col("o_orderkey").alias("record_id")))


def app_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("bundle"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_nationkey")).alias("app_level_id"))


def app_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("app_level_id"),
        F.col("n_name").alias("app_l1_name"),
        F.lower("n_name").alias("app_l2_name"),
        F.substring("n_name", 1, 3).alias("app_l3_name"),
        F.col("n_regionkey").alias("app_lifestage_id"))


def app_lifestage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("app_lifestage_id"), F.col("r_name").alias("lifestage_name"))


def age_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ifa"),
        F.pmod(F.col("c_nationkey"), F.lit(AGE_CLASSES)).cast("double").alias("prediction"))


def app_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: events per category, and of all categories (also unlisted ones)."""
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("ifa"), "event_type")
    return ev.groupBy("ifa").agg(*[F.nullif(F.count(F.when(F.col("event_type") == c, 1)), F.lit(0)).alias(c) for c in APP_CATEGORIES],
                                 F.count(F.lit(1)).alias("overall_brq"))


def place_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.concat(F.lit("RF_"), F.col("l_returnflag")).alias("place"))
    return (li.join(o, li.l_orderkey == o.o_orderkey, "inner")
            .groupBy(F.col("o_custkey").alias("ifa"))
            .agg(*[F.nullif(F.count(F.when(F.col("place") == c, 1)), F.lit(0)).alias(c) for c in PLACE_CODES],
                 F.count(F.lit(1)).alias("overall_brq_poi")))


def combined(spark: SparkSession, sf_dir: str, scores: DataFrame, device_price: DataFrame) -> DataFrame:
    """The wide per-device table the clustering job reads (no producer in the
    reference): scores + age class + device price + app and place counts."""
    apps = app_counts(spark, sf_dir)
    places = place_counts(spark, sf_dir)
    zero = F.lit(0).cast("bigint")
    app_cols = [F.coalesce(F.col(c), zero).alias(c) for c in APP_CATEGORIES]
    place_cols = [F.coalesce(F.col(c), zero).alias(c) for c in PLACE_CODES]
    overall, overall_poi = (F.coalesce(F.col(c), zero) for c in ("overall_brq", "overall_brq_poi"))
    return (scores
            .join(age_classes(spark, sf_dir), "ifa", "left")
            .join(device_price, "ifa", "left")
            .join(apps, "ifa", "left")
            .join(places, "ifa", "left")
            .select(*scores.columns, "prediction", "device_price",
                    overall.alias("overall_brq"), *app_cols,
                    overall_poi.alias("overall_brq_poi"), *place_cols))


def device_prices(spark: SparkSession, sf_dir: str, fx_rate: float = STANDIN_CONFIG.fx_rate) -> DataFrame:
    """Latest priced device per device id over all months."""
    return (latest_prices(devices(spark, sf_dir), fx_rate, ("ifa",))
            .withColumnRenamed("myr_price", "device_price"))


def recency_band(df: DataFrame, score: str = "r", out: str = "cluster", top: int = 4) -> DataFrame:
    """Rule-given segment labels (score band 0..top) for checking the profile
    operators against SQL, where k-means labels cannot be reproduced."""
    band = F.floor(F.col(score)).cast("int")
    return df.withColumn(out, F.when(band.isNotNull(), F.least(band, F.lit(top))))
