"""Small literal inputs with made-up device ids (FIXTURES.md §4 edge rows)."""

import datetime as dt

from pyspark.sql.types import (ArrayType, DoubleType, LongType, StringType, StructField,
                               StructType, TimestampType)

APP = StructType([StructField("bundle", StringType()), StructField("last_seen", TimestampType()),
                  StructField("brq_count", LongType())])
CONN = StructType([StructField("req_con_type_desc", StringType())])
USAGE = StructType([StructField("ifa", StringType()), StructField("app", ArrayType(APP)),
                    StructField("connection", ArrayType(CONN)), StructField("month", StringType())])
USERBASE = StructType([StructField("ifa", StringType()), StructField("req_con_type_desc", StringType()),
                       StructField("req_carrier_name", StringType())])
DEVICE = StructType([StructField("ifa", StringType()),
                     StructField("device", StructType([StructField("device_name", StringType()),
                                                       StructField("device_model", StringType()),
                                                       StructField("price", StringType())])),
                     StructField("month", StringType()), StructField("snapshot_ts", TimestampType()),
                     StructField("record_id", LongType())])

T = dt.datetime


def usage_rows():
    return [
        # two apps x two connections, one of them WIFI
        ("d001", [("b1", T(2021, 1, 26, 7, 12, 21), 2), ("b2", T(2021, 1, 26, 9, 0), 5)],
         [("4G",), ("WIFI",)], "202101"),
        ("d001", [("b1", T(2021, 3, 16, 7, 2, 19), 4)], [("4G",)], "202103"),
        ("d001", [("b3", T(2021, 3, 5, 13, 16, 51), 1)], [("4G",), ("3G",)], "202103"),
        # no apps / null apps
        ("d002", [], [("4G",)], "202101"),
        ("d002", None, [("4G",)], "202102"),
        # null, Unknown and lower-case wifi channels; same day twice
        ("d003", [("b1", T(2021, 4, 24, 1, 0), 3), ("b1", T(2021, 4, 24, 5, 0), 3)],
         [(None,), ("Unknown",), ("wifi",)], "202104"),
        # device missing from the userbase
        ("d004", [("b1", T(2021, 2, 1), 7)], [("4G",)], "202102"),
        # unmatched bundle, null count
        ("d005", [("zz", T(2021, 2, 2), 9), ("b1", T(2021, 2, 3), None)], [("4G",)], "202102"),
    ]


def userbase_rows():
    return [
        ("d001", "4G", "CarrierA"), ("d001", "WIFI", "CarrierA"), ("d001", "3G", "CarrierB"),
        ("d002", "4G", "CarrierA"),
        ("d003", "Unknown", "CarrierC"), ("d003", None, "CarrierC"), ("d003", "wifi", "CarrierC"),
        ("d005", "4G", "CarrierA"),
    ]


def device_rows():
    return [
        ("d001", ("n", "m", "100.0"), "202101", T(2021, 1, 5), 1),
        ("d001", ("n", "m2", "200.0"), "202101", T(2021, 1, 5), 2),      # same day: tie-break by id
        ("d001", ("n", "m", "0"), "202103", T(2021, 3, 1), 3),           # zero price as text
        ("d003", ("n", "m", "0.0"), "202104", T(2021, 4, 2), 4),
        ("d005", ("n", "m", None), "202102", T(2021, 2, 2), 5),
        ("d005", ("n", "m", "abc"), "202102", T(2021, 2, 1), 6),
        ("d002", ("n", "m", "50"), "202101", T(2021, 1, 9), 7),
    ]


def taxonomy_frames(spark):
    master = spark.createDataFrame(
        [("b1", "L1", "S1"), ("b2", "L2", "S1"), ("b3", "L1", None)],
        "bundle string, app_level_id string, app_lifestage_id string")
    level = spark.createDataFrame(
        [("L1", "Video Streaming", "VOD", "Movies"), ("L2", "Games", "Casual", "Puzzle")],
        "app_level_id string, app_l1_name string, app_l2_name string, app_l3_name string")
    lifestage = spark.createDataFrame([("S1", "Young")], "app_lifestage_id string, lifestage_name string")
    return master, level, lifestage


def frames(spark):
    return (spark.createDataFrame(usage_rows(), USAGE),
            spark.createDataFrame(userbase_rows(), USERBASE),
            spark.createDataFrame(device_rows(), DEVICE))


def measures_schema():
    return StructType([StructField("ifa", StringType()), StructField("v", DoubleType())])
