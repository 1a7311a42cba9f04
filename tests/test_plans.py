"""End-to-end jobs on the smallest test tables: scoring -> clustering -> profiles."""

import os
import tempfile

import pytest

from rfmlens.config import ClusteringConfig
from rfmlens.plans import clustering, profiling, scoring
from rfmlens.plans.registry import MEANS_OF, SHARE_GROUPS, scoring_inputs
from rfmlens.sources import standins as S

SMOKE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE), reason="test tables not present")


def test_jobs_end_to_end(spark):
    out = tempfile.mkdtemp(prefix="rfmlens-jobs-")
    scores = scoring.run(scoring_inputs(spark, SMOKE), S.STANDIN_CONFIG, f"{out}/rfm")
    n = scores.count()
    assert n > 0 and scores.select("ifa").distinct().count() == n
    assert os.path.isdir(f"{out}/rfm/spend_df") and os.path.isdir(f"{out}/rfm/dist_avg_spend")
    (check,) = spark.read.parquet(f"{out}/rfm/checks").collect()
    assert check.rows == check.distinct_keys == check.measures == n and check.is_unique
    main = spark.read.parquet(f"{out}/rfm/main_df")
    assert {"ub_rows", "date", "period_months", "days_since", "_day_sum"} <= set(main.columns) and main.count() > 0
    wide = S.combined(spark, SMOKE, scores, S.device_prices(spark, SMOKE))
    model, sweep = clustering.cluster_table(wide, ClusteringConfig(ks=(2, 3, 4), k=3), sweep=True, min_k=3)
    assert sweep.count() == 3
    k = model.select("cluster").distinct().count()
    assert 3 <= k <= 4
    report = profiling.run(model, f"{out}/profile", MEANS_OF, SHARE_GROUPS)
    assert report["means"].count() == k
    assert sum(r.ifa_count for r in report["means"].collect()) == model.count()
    everyone = spark.read.parquet(f"{out}/profile/ifa_list/all/parquet")
    assert everyone.count() == model.select("ifa").distinct().count()
    back = spark.read.option("header", "true").csv(f"{out}/profile/ifa_list/csv")
    assert back.count() == model.select("ifa").distinct().count()


def test_scoring_from_storage_layout(spark):
    """Real-input layout: nested userbase dirs, month-partitioned usage and
    devices, header CSV app tables -> same scores as the in-memory frames."""
    import datetime as dt

    from fixtures import frames, taxonomy_frames
    from rfmlens.config import ScoringConfig
    from rfmlens.plans.scoring import ScoringInputs, load_inputs
    from conftest import rows

    root = tempfile.mkdtemp(prefix="rfmlens-layout-")
    usage, ub, devices = frames(spark)
    master, level, lifestage = taxonomy_frames(spark)
    ub.write.parquet(f"{root}/user_base/part1")
    usage.write.partitionBy("month").parquet(f"{root}/usage")
    devices.write.partitionBy("month").parquet(f"{root}/device")
    for name, df in (("master", master), ("level", level), ("lifestage", lifestage)):
        df.coalesce(1).write.option("header", "true").csv(f"{root}/{name}")
    cfg = ScoringConfig(anchor_day=dt.date(2021, 4, 30))
    loaded = load_inputs(spark, f"{root}/user_base", f"{root}/usage", f"{root}/device",
                         f"{root}/master", f"{root}/level", f"{root}/lifestage",
                         months=["202101", "202102", "202103", "202104"])
    got = scoring.scores_frame(loaded, cfg)
    direct = scoring.scores_frame(ScoringInputs(ub, usage, devices, master, level, lifestage), cfg)
    assert got.count() > 0
    assert rows(got) == rows(direct.select(*got.columns))


def test_cli_score_cluster_profile(spark):
    """The three jobs through the command line, on fixture files in the real layout."""
    import datetime as dt

    from rfmlens import session

    def stages():
        folder = f"{session.shared_dir(spark)}/stages".removeprefix("file://")
        return set(os.listdir(folder)) if os.path.isdir(folder) else set()

    before = stages()

    from fixtures import frames, taxonomy_frames
    from rfmlens.plans import cli

    root = tempfile.mkdtemp(prefix="rfmlens-cli-")
    usage, ub, devices = frames(spark)
    master, level, lifestage = taxonomy_frames(spark)
    ub.write.parquet(f"{root}/user_base/part1")
    usage.write.partitionBy("month").parquet(f"{root}/usage")
    devices.write.partitionBy("month").parquet(f"{root}/device")
    for name, df in (("master", master), ("level", level), ("lifestage", lifestage)):
        df.coalesce(1).write.option("header", "true").csv(f"{root}/{name}")
    cli.main(["score", "--userbase", f"{root}/user_base", "--usage", f"{root}/usage",
              "--devices", f"{root}/device", "--app-master", f"{root}/master",
              "--app-level", f"{root}/level", "--app-lifestage", f"{root}/lifestage",
              "--out", f"{root}/rfm", "--months", "202101,202102,202103,202104"], spark)
    scores = spark.read.parquet(f"{root}/rfm/output_rfm")
    assert scores.count() >= 1
    assert session._STAGES == [] and stages() <= before   # removed when the job ends
    # a wide table around the scored device (60 rows, enough to cluster)
    first = scores.first()
    wide = spark.createDataFrame(
        [("d%d" % i, first.avg_spend + i, float(i % 4), first.last_seen + i % 7, i * 3.0,
          first.usage_frequency, i % 5) for i in range(60)],
        "ifa string, avg_spend double, prediction double, last_seen int, device_price double, "
        "usage_frequency double, overall_brq long")
    wide.write.parquet(f"{root}/wide")
    cli.main(["cluster", "--wide", f"{root}/wide", "--out", f"{root}/cl", "--ks", "2,3", "--k", "3",
              "--sweep", "--min-k", "2"], spark)
    model = spark.read.parquet(f"{root}/cl/clustered")
    assert model.count() == 60 and "cluster" in model.columns
    cli.main(["profile", "--clustered", f"{root}/cl/clustered", "--out", f"{root}/prof",
              "--means-of", "avg_spend,device_price,overall_brq"], spark)
    assert spark.read.option("header", "true").csv(f"{root}/prof/means").count() == \
        model.select("cluster").distinct().count()


def test_fused_usage_scan_equals_separate_operators(spark):
    """measures_frame(fused) reads usage in one job; same measures as the operators run apart."""
    import datetime as dt

    from fixtures import frames, taxonomy_frames
    from rfmlens.config import ScoringConfig
    from rfmlens.plans.inspect import read_schemas
    from rfmlens.plans.scoring import ScoringInputs, measures_frame
    from conftest import rows

    usage, ub, devices = frames(spark)
    master, level, lifestage = taxonomy_frames(spark)
    master = master.unionByName(master.where("bundle = 'b1'"))      # duplicated taxonomy row
    inp = ScoringInputs(ub, usage, devices, master, level, lifestage)
    cfg = ScoringConfig(anchor_day=dt.date(2021, 4, 30))
    fused, apart = measures_frame(inp, cfg, fused=True), measures_frame(inp, cfg, fused=False)
    assert rows(fused) == rows(apart) and fused.count() > 0
    smoke = "/root/testdata/sf0.001"
    if os.path.isdir(smoke):
        from rfmlens.plans.registry import CFG, scoring_inputs
        inp_smoke = scoring_inputs(spark, smoke)
        plan_schemas = read_schemas(measures_frame(inp_smoke, CFG, fused=True))
        # the usage source was read once, by the staged grouping-sets job; the
        # measures plan itself only reads the stage
        assert sum("l_orderkey" in x for x in plan_schemas) == 0
        assert sum("l_orderkey" in x for x in read_schemas(measures_frame(inp_smoke, CFG))) == 2


def test_scoring_job_reads_usage_twice(spark):
    """Once for the day and category sums, once for the histogram."""
    import datetime as dt

    from pyspark.sql import functions as F
    from fixtures import frames, taxonomy_frames
    from rfmlens.config import ScoringConfig
    from rfmlens.plans.scoring import ScoringInputs

    usage, ub, devices = frames(spark)
    reads = spark.sparkContext.accumulator(0)
    n = usage.count()

    @F.udf("string")
    def seen(x):
        reads.add(1)
        return x

    counted = usage.withColumn("ifa", seen.asNondeterministic()("ifa"))
    out = tempfile.mkdtemp(prefix="rfmlens-scan-")
    cfg = ScoringConfig(anchor_day=dt.date(2021, 4, 30))
    got = scoring.run(ScoringInputs(ub, counted, devices, *taxonomy_frames(spark)), cfg, out)
    assert got.count() > 0 and reads.value <= 2 * n
