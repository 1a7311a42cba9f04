"""Declared schemas of the real inputs (the reference declares none; see
FIXTURES.md). The readers check them against the file's own schema by name and
cast, so a missing or renamed column or field raises before any job runs, and
a price may be text or a number upstream."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, DoubleType, LongType, StringType, StructField,
                               StructType, TimestampType)

USERBASE = StructType([
    StructField("ifa", StringType(), False),
    StructField("req_con_type_desc", StringType()),
    StructField("req_carrier_name", StringType()),
])

APP_USE = StructType([
    StructField("bundle", StringType()),
    StructField("last_seen", TimestampType()),
    StructField("brq_count", LongType()),
])

CONNECTION = StructType([StructField("req_con_type_desc", StringType())])

USAGE = StructType([
    StructField("ifa", StringType(), False),
    StructField("app", ArrayType(APP_USE)),
    StructField("connection", ArrayType(CONNECTION)),
    StructField("month", StringType()),          # partition column yyyyMM
])

DEVICE = StructType([
    StructField("ifa", StringType(), False),
    StructField("device", StructType([
        StructField("device_name", StringType()),
        StructField("device_model", StringType()),
        StructField("price", StringType()),      # text or number upstream; parsed as a number
    ])),
    StructField("month", StringType()),
    StructField("snapshot_ts", TimestampType()),  # tie-break the reference lacks
    StructField("record_id", LongType()),
])

APP_MASTER = StructType([StructField(c, StringType()) for c in
                         ("bundle", "app_level_id", "app_lifestage_id")])
APP_LEVEL = StructType([StructField(c, StringType()) for c in
                        ("app_level_id", "app_l1_name", "app_l2_name", "app_l3_name")])
APP_LIFESTAGE = StructType([StructField(c, StringType()) for c in
                            ("app_lifestage_id", "lifestage_name")])

SPEND = StructType([
    StructField("ifa", StringType(), False),
    StructField("month", StringType()),
    StructField("spend", DoubleType()),
])
