"""

    python tools/measure.py rank  [rows ...]   # EXT-1 vs the built-in global window
    python tools/measure.py skew  [rows]       # factorised daily use vs the pair join, event-log metrics

Data and event logs go to a fresh ``mktemp`` folder under /tmp; nothing is
written elsewhere. These are measurement tools, not registered queries.
"""

from __future__ import annotations

import datetime as dt
import glob
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def _session(scratch: str, event_log: bool = False) -> SparkSession:
    b = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g"))
    if event_log:
        os.makedirs(f"{scratch}/evlog", exist_ok=True)
        b = b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"{scratch}/evlog")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(f"{scratch}/ckpt")
    return spark


def rank(scratch: str, sizes: list[int]) -> dict:
    from rfmlens.operators.rank import RankSpec, percent_rank_window, percent_ranks
    spark = _session(scratch)
    out = {}
    for n in sizes:
        path = f"{scratch}/rank_{n}"
        spark.range(n).select("id", (F.rand(7) * 1e9).alias("many"),
                              (F.col("id") % 120).cast("int").alias("few")).write.parquet(path)
        df = spark.read.parquet(path)
        for col in ("many", "few"):
            t0 = time.perf_counter()
            percent_ranks(df, [RankSpec(col, True, "p")]).write.format("noop").mode("overwrite").save()
            t1 = time.perf_counter()
            percent_rank_window(df, col, True, "p").write.format("noop").mode("overwrite").save()
            t2 = time.perf_counter()
            out[f"{n}:{col}"] = {"ext1": round(t1 - t0, 2), "builtin_window": round(t2 - t1, 2)}
    spark.stop()
    return out


def _event_stats(evdir: str) -> dict:
    import zstandard
    stage_group, stats = {}, {}
    for path in sorted(glob.glob(f"{evdir}/*/events_*") + glob.glob(f"{evdir}/*")):
        if os.path.isdir(path):
            continue
        with open(path, "rb") as fh:
            raw = (zstandard.ZstdDecompressor().stream_reader(fh, read_across_frames=True).read()
                   if path.endswith(".zstd") else fh.read())
        for line in io.StringIO(raw.decode("utf-8", "replace")):
            if not line.strip().startswith("{"):
                continue
            e = json.loads(line)
            if e.get("Event") == "SparkListenerJobStart":
                g = (e.get("Properties") or {}).get("spark.jobGroup.id")
                for sid in e.get("Stage IDs", []):
                    stage_group[sid] = g
            elif e.get("Event") == "SparkListenerTaskEnd":
                g = stage_group.get(e["Stage ID"])
                m = e.get("Task Metrics") or {}
                sw, sr = m.get("Shuffle Write Metrics", {}), m.get("Shuffle Read Metrics", {})
                st = stats.setdefault(g, {"shuffle_write_MB": 0.0, "max_task_read_records": 0, "max_task_ms": 0})
                st["shuffle_write_MB"] += sw.get("Shuffle Bytes Written", 0) / 1e6
                st["max_task_read_records"] = max(st["max_task_read_records"], sr.get("Total Records Read", 0))
                st["max_task_ms"] = max(st["max_task_ms"], e["Task Info"]["Finish Time"] - e["Task Info"]["Launch Time"])
    return {g: {k: round(v, 1) for k, v in st.items()} for g, st in stats.items() if g}


def skew(scratch: str, n: int) -> dict:
    from rfmlens.operators.usage import daily_usage, with_usage_dates
    spark = _session(scratch, event_log=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # the userbase is large at scale
    anchor = dt.date(2021, 4, 30)
    spark.range(n).select(   # one device holds a third of all rows
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 400_000).alias("ifa"),
        (F.lit(dt.datetime(2021, 1, 1)) + F.make_interval(mins=(F.col("id") % 172800).cast("int"))).alias("last_seen"),
        (F.col("id") % 50).alias("brq_count")).write.parquet(f"{scratch}/ev")
    ids = spark.range(-1, 400_000).select(F.col("id").alias("ifa"))
    ub_rows = None   # four userbase rows per device, one of them excluded (WIFI)
    for c in ("4G", "3G", "WIFI", "LTE"):
        part = ids.withColumn("req_con_type_desc", F.lit(c))
        ub_rows = part if ub_rows is None else ub_rows.unionByName(part)
    ub_rows.write.parquet(f"{scratch}/ub")
    ev, ub = spark.read.parquet(f"{scratch}/ev"), spark.read.parquet(f"{scratch}/ub")
    times = {}
    spark.sparkContext.setJobGroup("factorised", "factorised")
    t0 = time.perf_counter()
    daily_usage(ev, ub, anchor, ("WIFI",)).write.format("noop").mode("overwrite").save()
    times["factorised"] = round(time.perf_counter() - t0, 2)
    spark.sparkContext.setJobGroup("pairs", "pairs")
    t0 = time.perf_counter()
    main = with_usage_dates(ub.join(ev, "ifa"), anchor)
    (main.filter(~F.col("req_con_type_desc").like("WIFI"))
     .groupBy("ifa", "date", "period_months", "days_since").agg(F.sum("brq_count").alias("s"))
     .write.format("noop").mode("overwrite").save())
    times["pairs"] = round(time.perf_counter() - t0, 2)
    spark.stop()
    return {"wall_s": times, "event_log": _event_stats(f"{scratch}/evlog")}


if __name__ == "__main__":
    what = sys.argv[1] if len(sys.argv) > 1 else "rank"
    scratch = tempfile.mkdtemp(prefix="rfmlens-measure-")
    if what == "rank":
        sizes = [int(x) for x in sys.argv[2:]] or [1_000_000, 4_000_000, 16_000_000]
        print(json.dumps(rank(scratch, sizes)))
    else:
        print(json.dumps(skew(scratch, int(sys.argv[2]) if len(sys.argv) > 2 else 6_000_000)))
