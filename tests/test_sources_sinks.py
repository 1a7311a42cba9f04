"""SRC-*/SNK-*: partitioned writes, pruned reads, segment exports."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import rows
from rfmlens.functions.dates import month_token
from rfmlens.sources.readers import (month_ranges, months_predicate, read_csv_typed, read_month_dirs,
                                     read_monthly, read_tree, with_source_file)
from rfmlens.plans.inspect import partition_filters, plan_text, pushed_filters
from rfmlens.sources.sinks import write_csv, write_parquet, write_segments


def _tmp():
    return tempfile.mkdtemp(prefix="rfmlens-test-")


def _plan(df):
    return plan_text(df)


def test_month_partitions_pruned(spark):
    root = _tmp() + "/usage"
    df = spark.createDataFrame([("d1", "202101", 1), ("d2", "202102", 2), ("d3", "202103", 3)],
                               "ifa string, month string, n int")
    write_parquet(df, root, mode="overwrite", partition_by=["month"])
    back = read_monthly(spark, root, ["202101", "202103"])
    assert rows(back, "ifa", "month") == [("d1", "202101"), ("d3", "202103")]
    assert any("month" in f for f in partition_filters(back))
    # dynamic overwrite replaces only the written month
    write_parquet(df.where("month = '202101'").withColumn("n", F.lit(9)), root, mode="overwrite",
                  partition_by=["month"])
    assert rows(read_monthly(spark, root), "month", "n") == [("202101", 9), ("202102", 2), ("202103", 3)]


def test_legacy_month_dirs_and_lineage(spark):
    root = _tmp() + "/legacy"
    for m in ("202101", "202102", "202103"):
        spark.createDataFrame([("d" + m, 1)], "ifa string, n int").write.parquet(f"{root}/{m}")
    back = read_month_dirs(spark, root, ["202101", "202103"])
    assert rows(back, "ifa", "month") == [("d202101", "202101"), ("d202103", "202103")]
    assert read_tree(spark, root).count() == 3
    assert with_source_file(read_tree(spark, root)).where(F.col("filename").contains("/202102/")).count() == 1
    tok = spark.createDataFrame([("s3a://b/x/y/z/202104/part-0.parquet",), ("/r/month=202105/p.parquet",),
                                 ("/r/x202106/p.parquet",)], "p string")
    assert [r[0] for r in tok.select(month_token("p")).collect()] == ["202104", "202105", ""]


def test_months_predicate_pushed(spark, tmp_path):

    p = str(tmp_path / "t")
    spark.createDataFrame([(dt.datetime(2021, m, 3),) for m in range(1, 13)], "ts timestamp_ntz").write.parquet(p)
    df = spark.read.parquet(p).where(months_predicate("ts", ["202102", "202103", "202107"]))
    assert df.count() == 3
    pushed = " ".join(pushed_filters(df))
    assert "GreaterThanOrEqual(ts,2021-02-01T00:00)" in pushed and "LessThan(ts,2021-04-01T00:00)" in pushed
    assert month_ranges(["202112", "202201", "202203"])[0] == (dt.date(2021, 12, 1), dt.date(2022, 2, 1))


def test_segments_csv_and_errorifexists(spark):
    root = _tmp()
    m = spark.createDataFrame([("d1", 0), ("d2", 0), ("d2", 0), ("d3", 11)], "ifa string, cluster int")
    write_segments(m, root + "/pq")
    assert rows(spark.read.parquet(root + "/pq"), "cluster", "ifa") == [(0, "d1"), (0, "d2"), (11, "d3")]
    with pytest.raises(Exception):
        write_segments(m, root + "/pq")
    write_segments(m, root + "/csv", fmt="csv", label="Mobile Device ID", files_per_segment=1)
    files = [f for f in os.listdir(root + "/csv/cluster=0") if f.endswith(".csv")]
    assert len(files) == 1                             # one file per segment
    write_segments(m, root + "/csv3", fmt="csv", files_per_segment=3)
    assert spark.read.option("header", "true").csv(root + "/csv3").count() == 3
    back = spark.read.option("header", "true").csv(root + "/csv")
    assert "Mobile Device ID" in back.columns and back.count() == 3
    write_csv(m, root + "/report", single_file=True)
    assert read_csv_typed(spark, root + "/report").count() == 4


def test_shared_dir_resolution_order():
    """Session setting first, then the context's checkpoint folder; a private
    folder only when neither exists (spark.checkpoint.dir is launch-time, so
    the session objects are stand-ins here)."""
    from rfmlens.session import shared_dir, stage_path

    class Conf(dict):
        def get(self, k, default=None):
            return dict.get(self, k, default)

    class Ctx:
        def __init__(self, conf, ckpt=None, master="local[8]"):
            self._conf, self.ckpt, self.master = Conf(conf), ckpt, master
        def getConf(self):
            return self._conf
        def getCheckpointDir(self):
            return self.ckpt
        def setCheckpointDir(self, d):
            self.ckpt = d

    class Sess:
        def __init__(self, conf, ctx):
            self.conf, self.sparkContext = Conf(conf), ctx

    assert shared_dir(Sess({"spark.checkpoint.dir": "s3a://b/ck/"}, Ctx({}))) == "s3a://b/ck"
    assert shared_dir(Sess({}, Ctx({"spark.checkpoint.dir": "hdfs:///ck"}))) == "hdfs:///ck"
    assert shared_dir(Sess({}, Ctx({}, "hdfs:///ck/0a1b2c"))) == "hdfs:///ck"
    ctx = Ctx({})
    own = shared_dir(Sess({}, ctx))
    assert ctx.ckpt == own and os.path.isdir(own)
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(Sess({}, Ctx({}, master=master)))
    assert stage_path(Sess({"spark.checkpoint.dir": "s3a://b/ck"}, Ctx({})), "m").startswith("s3a://b/ck/stages/m-")


def test_csv_columns_are_bound_by_name(spark):
    from pyspark.sql import types as T
    from rfmlens.sources.readers import read_csv_by_name
    root = _tmp()
    spark.createDataFrame([("Netflix", "l1", "b1", "s1", "3")], "app_name string, app_level_id string, bundle string, app_lifestage_id string, n string"
                          ).write.option("header", "true").csv(root + "/wide")
    schema = T.StructType([T.StructField("bundle", T.StringType()), T.StructField("app_level_id", T.StringType()), T.StructField("n", T.LongType())])
    assert [tuple(r) for r in read_csv_by_name(spark, root + "/wide", schema).collect()] == [("b1", "l1", 3)]
    with pytest.raises(ValueError, match="no_such"):
        read_csv_by_name(spark, root + "/wide", T.StructType([T.StructField("no_such", T.StringType())]))


def test_parquet_names_and_types_are_checked(spark):
    from rfmlens import schemas
    from rfmlens.sources.readers import conform, read_monthly
    root = _tmp()
    good = spark.createDataFrame([("d1", ("a", "b", 19.5), "202101", dt.datetime(2021, 1, 2), 4)],
                                 "ifa string, device struct<device_name: string, device_model: string, price: double>, month string, "
                                 "snapshot_ts timestamp, record_id long")
    good.write.partitionBy("month").parquet(root + "/good")
    (r,) = read_monthly(spark, root + "/good", None, schemas.DEVICE).collect()
    assert r.device.price == "19.5" and r.month == "202101"
    for bad in (good.withColumnRenamed("ifa", "id"), good.drop("record_id"),
                good.withColumn("device", F.struct(F.col("device.device_name")))):
        with pytest.raises(ValueError):
            conform(bad, schemas.DEVICE)
    assert read_monthly(spark, root + "/good", []).count() == 0
    assert read_monthly(spark, root + "/good", ["202101"]).count() == 1


def test_null_ids_in_lists_and_exports_agree(spark):
    from rfmlens.operators.audience import audience_all, audience_lists, export_audiences
    root = _tmp()
    m = spark.createDataFrame([("d1", 0), (None, 0), (None, 1), ("d1", 0)], "ifa string, cluster int")
    for drop, n, everyone in ((False, 3, 2), (True, 1, 1)):
        export_audiences(m, f"{root}/{drop}", drop_null_ids=drop)
        assert spark.read.parquet(f"{root}/{drop}").count() == audience_lists(m, drop_null_ids=drop).count() == n
        assert audience_all(m, drop_null_ids=drop).count() == everyone


def test_partitioned_writes_make_few_files(spark):
    root = _tmp()
    df = spark.range(0, 6000, numPartitions=8).select("id", F.format_string("2021%02d", F.col("id") % 12 + 1).alias("month"))
    write_parquet(df, root + "/m", mode="overwrite", partition_by=["month"])
    files = [f for d, _, names in os.walk(root + "/m") for f in names if f.endswith(".parquet")]
    assert 12 <= len(files) <= 24 and read_monthly(spark, root + "/m").count() == 6000
