"""Refreshes by month: stored histograms, RFM state, mixed file types, months that lose their rows, files by size."""

import datetime as dt
import random

import pytest
from conftest import rows
from fixtures import USAGE, frames, taxonomy_frames
from pyspark.sql import functions as F

from rfmlens import schemas
from rfmlens.config import ScoringConfig
from rfmlens.operators.audience import key_sketches, merged_counts
from rfmlens.operators.rank import RankSpec, changed_counts, percent_ranks, ranks_from_counts, value_counts
from rfmlens.operators.rfm import refresh_rfm_months, rfm_base, rfm_base_of
from rfmlens.operators.spend import latest_prices
from rfmlens.sources.readers import parquet_files, read_monthly
from rfmlens.sources.sinks import write_segments
from rfmlens.streaming import monthly_spend_stream


@pytest.mark.parametrize("descending,keep", [(False, True), (True, False), (True, True)])
def test_ranks_after_changes_equal_full_ranks(spark, descending, keep):
    rng = random.Random(4)
    value = lambda: rng.choice([None, 1.0, 2.5, rng.randint(0, 9) / 2, -0.0])
    old = {i: value() for i in range(300)}
    new = old | {i: value() for i in range(0, 300, 7)} | {i: value() for i in range(300, 320)}
    df = lambda d: spark.createDataFrame(list(d.items()), "ifa long, v double")
    spec = RankSpec("v", descending, "p", keep)
    gone = df({i: old[i] for i in range(0, 300, 7)})
    come = df({i: new[i] for i in [*range(0, 300, 7), *range(300, 320)]})
    counts = changed_counts(value_counts(df(old), spec), gone, come, spec)
    got = ranks_from_counts(df(new), [(spec, counts)], 5)
    assert rows(got) == rows(percent_ranks(df(new), [spec], buckets=3))


def days(spark, spec):
    data = [(i, dt.date(2021, m, d), float(4 - m), 100 - 30 * m - d, n) for i, m, d, n in spec]
    return spark.createDataFrame(data, "ifa string, date date, period_months double, days_since int, sum_brq_daily long")


def test_rfm_state_with_late_corrected_and_lost_months(spark, tmp_path):
    state = str(tmp_path / "state")
    first = days(spark, [("a", 1, 5, 3), ("a", 2, 7, 4), ("b", 2, 1, 9)])
    refresh_rfm_months(state, first, ["202101", "202102"])
    assert rows(rfm_base_of(spark.read.parquet(state))) == rows(rfm_base(first))
    late = days(spark, [("a", 1, 2, 1), ("c", 1, 9, None), ("a", 3, 1, 5)])
    refresh_rfm_months(state, late, ["202101", "202103"])
    want = days(spark, [("a", 1, 2, 1), ("c", 1, 9, None), ("a", 2, 7, 4), ("b", 2, 1, 9), ("a", 3, 1, 5)])
    assert rows(rfm_base_of(spark.read.parquet(state))) == rows(rfm_base(want))
    refresh_rfm_months(state, late.where("false"), ["202102"])   # the month lost all its days
    assert rows(rfm_base_of(spark.read.parquet(state))) == rows(rfm_base(late))


def mixed(spark, root):
    """A month with the price as text, one as double, one as decimal, one with files of both kinds."""
    ts = dt.datetime(2021, 1, 5)
    kinds = {"202101": ("string", ["10.5", "n/a"]), "202102": ("double", [20.25, None]), "202103": ("decimal(10,2)", [30, 0]),
             "202104": ("string", ["40.0", None])}
    for m, (kind, prices) in kinds.items():
        df = spark.createDataFrame([(f"d{i}", "n", "m", None if p is None else str(p), ts, i) for i, p in enumerate(prices)],
                                   "ifa string, n string, m string, p string, snapshot_ts timestamp, record_id long")
        price = F.col("p").cast(kind)
        device = F.struct(F.col("n").alias("device_name"), F.col("m").alias("device_model"), price.alias("price"))
        for k, d in ((kind, device), *([("double", device)] if m == "202104" else [])):
            more = df if k == kind else df.withColumn("record_id", F.col("record_id") + 10)
            more.select("ifa", d.withField("price", price.cast(k)).alias("device"), "snapshot_ts", "record_id").write.mode("append").parquet(f"{root}/month={m}")


def test_months_of_differing_types(spark, tmp_path):
    root = str(tmp_path / "devices")
    mixed(spark, root)
    df = read_monthly(spark, root, schema=schemas.DEVICE)
    assert df.schema["device"].dataType["price"].dataType.simpleString() == "string" and df.count() == 10
    got = rows(latest_prices(df, 2.0, ("ifa", "month")))
    assert got == [("d0", "202101", 21.0), ("d0", "202102", 40.5), ("d0", "202103", 60.0), ("d0", "202104", 80.0)]
    some = read_monthly(spark, root, ["202102", "202104"], schemas.DEVICE)
    assert rows(some.select("month").distinct()) == [("202102",), ("202104",)]
    assert read_monthly(spark, root, [], schemas.DEVICE).count() == 0
    spark.createDataFrame([("x", 1)], "ifa string, other int").write.parquet(f"{root}/month=202105")
    with pytest.raises(ValueError, match="lacks"):
        read_monthly(spark, root, schema=schemas.DEVICE)


def test_missing_folder_is_told_from_other_faults(spark, tmp_path):
    assert parquet_files(spark, str(tmp_path / "nothing")) == []
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        read_monthly(spark, str(tmp_path / "bad"), schema=schemas.DEVICE)


def spend_of(spark, tmp_path, usage, device_schema=None):
    out, tax = str(tmp_path / "spend"), taxonomy_frames(spark)
    from rfmlens.operators.taxonomy import app_taxonomy
    q = monthly_spend_stream(spark, str(tmp_path / "usage"), USAGE, str(tmp_path / "devices"), app_taxonomy(*tax), out, ScoringConfig(),
                             str(tmp_path / "ckpt"), device_schema=device_schema)
    q.awaitTermination()
    return rows(read_monthly(spark, out).select("ifa", "month"))


def test_stream_empties_a_month_that_lost_its_price(spark, tmp_path):
    usage, _, devices = frames(spark)
    usage.write.partitionBy("month").parquet(str(tmp_path / "usage"))
    devices.where("month = '202101'").write.partitionBy("month").parquet(str(tmp_path / "devices"))
    assert spend_of(spark, tmp_path, usage) == [("d001", "202101")]
    last = devices.where("month = '202101'").withColumns({"device": F.col("device").withField("price", F.lit(None).cast("string")),
                                                          "snapshot_ts": F.col("snapshot_ts") + F.expr("interval 1 day")})
    last.write.mode("append").partitionBy("month").parquet(str(tmp_path / "devices"))
    assert spend_of(spark, tmp_path, usage) == []
    devices.where("month = '202101'").withColumn("snapshot_ts", F.col("snapshot_ts") + F.expr("interval 2 days")).write.mode(
        "append").partitionBy("month").parquet(str(tmp_path / "devices"))
    assert spend_of(spark, tmp_path, usage) == [("d001", "202101")]


def test_stream_reads_prices_as_numbers(spark, tmp_path):
    usage, _, devices = frames(spark)
    usage.write.partitionBy("month").parquet(str(tmp_path / "usage"))
    number = devices.withColumn("device", F.col("device").withField("price", F.col("device.price").try_cast("double")))
    number.where("month = '202101'").write.partitionBy("month").parquet(str(tmp_path / "devices"))
    assert spend_of(spark, tmp_path, usage) == [("d001", "202101")]


def test_files_of_a_given_number_of_rows(spark, tmp_path):
    df = spark.createDataFrame([(i % 3 if i < 90 else 7, f"d{i:03}") for i in range(250)] * 2 + [(None, "n")], "cluster int, ifa string")
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        write_segments(df, path, fmt=fmt, rows_per_file=25, label="Mobile Device ID")
        back = (spark.read.parquet(path) if fmt == "parquet" else spark.read.option("header", "true").csv(path)).withColumn("f", F.col("_metadata.file_path"))
        per = {}
        for r in back.groupBy("cluster", "f").count().collect():
            per.setdefault(r.cluster, []).append(r["count"])
        assert {k: (len(v), sum(v), max(v)) for k, v in per.items()} == {0: (2, 30, 25), 1: (2, 30, 25), 2: (2, 30, 25), 7: (7, 160, 25), None: (1, 1, 1)}


def test_sketches_merge(spark):
    df = spark.range(6000).select((F.col("id") % 4).alias("month"), (F.col("id") % 2500).alias("ifa"))
    stored = key_sketches(df, ["month"])
    n = merged_counts(stored).first().n_keys
    assert abs(n - 2500) < 75 and stored.count() == 4


def test_small_files_are_written_by_all_tasks(spark, tmp_path):
    """Files cost their number: they aren't merged into one task because they are small."""
    df = spark.range(2000).select((F.col("id") % 4).cast("int").alias("cluster"), F.col("id").cast("string").alias("ifa"))
    path = tmp_path / "many"
    write_segments(df, str(path), fmt="csv", rows_per_file=10, label="Mobile Device ID")
    names = [f.name for f in path.glob("cluster=*/part-*.csv")]
    assert len(names) == 200 and len({n.split("-")[1] for n in names}) > 4
