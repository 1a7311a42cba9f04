"""Incremental monthly spend: stream result equals the batch result."""

import os
import tempfile


from conftest import rows
from fixtures import USAGE, frames, taxonomy_frames
from rfmlens.config import ScoringConfig
from rfmlens.operators.spend import category_usage, latest_device, monthly_spend, priced_devices
from rfmlens.operators.taxonomy import app_taxonomy
from rfmlens.sources.readers import read_monthly
from rfmlens.streaming import monthly_spend_stream


def _batch_spend(usage, devices, tax, cfg):
    priced = priced_devices(latest_device(devices, ("ifa", "month")), cfg.fx_rate)
    return monthly_spend(priced, category_usage(usage, tax, cfg.category, cfg.category_col, cfg.spend_excluded))


def test_stream_refreshes_touched_months(spark):
    root = tempfile.mkdtemp(prefix="rfmlens-stream-")
    usage, _, devices = frames(spark)
    tax = app_taxonomy(*taxonomy_frames(spark))
    cfg = ScoringConfig()
    schema = USAGE  # already carries month as a string column
    first = usage.where("month in ('202101', '202102')")
    first.write.partitionBy("month").parquet(f"{root}/usage")
    devices.write.partitionBy("month").parquet(f"{root}/devices")
    out, ckpt = f"{root}/spend", f"{root}/ckpt"

    q = monthly_spend_stream(spark, f"{root}/usage", schema, f"{root}/devices", tax, out, cfg, ckpt,
                             device_schema=devices.schema)
    q.awaitTermination(120)
    dev = read_monthly(spark, f"{root}/devices")
    expected = _batch_spend(first, dev, tax, cfg)
    assert rows(read_monthly(spark, out).select("ifa", "month", "spend")) == rows(expected.select("ifa", "month", "spend"))

    # a later month arrives (and a late file for January): only those months are redone
    import datetime as dt
    late = spark.createDataFrame([("d001", [("b1", dt.datetime(2021, 1, 28), 10)], [("4G",)], "202101")], USAGE)
    arriving = usage.where("month in ('202103')").unionByName(late)
    arriving.write.mode("append").partitionBy("month").parquet(f"{root}/usage")
    q = monthly_spend_stream(spark, f"{root}/usage", schema, f"{root}/devices", tax, out, cfg, ckpt,
                             device_schema=devices.schema)
    q.awaitTermination(120)
    expected = _batch_spend(first.unionByName(arriving), dev, tax, cfg)
    assert rows(expected.where("ifa = 'd001' and month = '202101'"), "spend") == [(838.0,)]
    got = read_monthly(spark, out).select("ifa", "month", "spend")
    assert rows(got) == rows(expected.select("ifa", "month", "spend"))
    assert os.path.isdir(ckpt)


def test_devices_that_arrive_after_the_usage(spark):
    root = tempfile.mkdtemp(prefix="rfmlens-stream-")
    usage, _, devices = frames(spark)
    tax = app_taxonomy(*taxonomy_frames(spark))
    cfg = ScoringConfig()
    out, ckpt = f"{root}/spend", f"{root}/ckpt"
    usage.write.partitionBy("month").parquet(f"{root}/usage")
    os.makedirs(f"{root}/devices")

    def run():
        q = monthly_spend_stream(spark, f"{root}/usage", USAGE, f"{root}/devices", tax, out, cfg, ckpt,
                                 device_schema=devices.schema)
        q.awaitTermination()

    run()
    first = devices.where("month = '202101'")
    first.write.mode("append").partitionBy("month").parquet(f"{root}/devices")
    run()
    expected = _batch_spend(usage, first, tax, cfg)
    assert expected.count() > 0
    assert rows(read_monthly(spark, out).select("ifa", "month", "spend")) == rows(expected.select("ifa", "month", "spend"))
    devices.where("month <> '202101'").write.mode("append").partitionBy("month").parquet(f"{root}/devices")
    run()
    expected = _batch_spend(usage, devices, tax, cfg)
    assert rows(read_monthly(spark, out).select("ifa", "month", "spend")) == rows(expected.select("ifa", "month", "spend"))
