"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query runs the library's operators over the whole test tables through
the role mapping in ``rfmlens.sources.standins``. The matching DuckDB SQL is in
``rfmlens.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from rfmlens.config import REFERENCE_AUDIENCE_LABEL, REFERENCE_FEATURES, REFERENCE_SWEEP_KS
from rfmlens.operators import kmeans
from rfmlens.operators.audience import audience_all, audience_lists, export_audiences, key_sketches, merged_counts
from rfmlens.operators.colocated import join_stored, store_by_key
from rfmlens.operators.checks import row_reconciliation, uniqueness_check
from rfmlens.operators.cluster import (SCALED_COL, assign, assign_clusters, choose_k, fit_kmeans, lloyd,
                                       nearest, prepare_features, scaled_columns, silhouette,
                                       silhouette_sweep)
from rfmlens.operators.order import global_row_number
from rfmlens.operators.quantiles import exact_quantiles
from rfmlens.operators.rank import RankSpec, changed_counts, percent_ranks, ranks_from_counts, value_counts
from rfmlens.operators.profile import (band_distribution, band_values, category_shares,
                                       cluster_means, mean_vs_median)
from rfmlens.operators.rfm import refresh_rfm_months, rfm_base, rfm_base_of, rfm_scores
from rfmlens.operators.spend import category_usage, latest_device, latest_prices, peak_spend
from rfmlens.operators.taxonomy import app_taxonomy
from rfmlens.operators.usage import channel_links, cross_counts, enrich_usage, enriched_daily_summary, explode_apps, with_usage_dates
from rfmlens.plans import scoring
from rfmlens.functions.scalar import try_double
from rfmlens.plans.profiling import load_clustered, round_doubles
from rfmlens.session import cut_lineage, stage_path
from rfmlens.sources import standins as S
from rfmlens.schemas import USERBASE
from rfmlens.sources.readers import (months_predicate, read_csv_by_name, read_csv_typed, read_month_dirs,
                                     read_monthly, read_tree)
from rfmlens.sources.sinks import write_csv, write_parquet

CFG = S.STANDIN_CONFIG
FEATURES = REFERENCE_FEATURES
MEANS_OF = ("r", "vf", "m", "usage_frequency", "avg_spend", "last_seen", "device_price",
            "overall_brq", *S.APP_CATEGORIES, "overall_brq_poi", *S.PLACE_CODES)
SHARE_GROUPS = {"overall_brq": S.APP_CATEGORIES, "overall_brq_poi": S.PLACE_CODES}
# Four months ending at the anchor month, like the reference's 2021-01..04.
# The month list is the parameter of the month-selecting readers under test
# (SRC-2/3/8); every other query reads all months of the whole tables.
WINDOW_MONTHS = ("200105", "200106", "200107", "200108")
REPORT_DIGITS = 6


def scoring_inputs(spark: SparkSession, d: str) -> scoring.ScoringInputs:
    return scoring.ScoringInputs(
        userbase=S.userbase(spark, d), usage=S.usage(spark, d), devices=S.devices(spark, d),
        app_master=S.app_master(spark, d), app_level=S.app_level(spark, d),
        app_lifestage=S.app_lifestage(spark, d))


def q_explode_usage(spark, d):
    return explode_apps(S.usage(spark, d))


def q_explode_star(spark, d):
    """PRJ-3: every field of the exploded struct."""
    return explode_apps(S.usage(spark, d), fields=None)


def q_explode_cross(spark, d):
    """GEN-2 as written: a record's apps times its connections (a handful each), counted."""
    return cross_counts(S.usage(spark, d))


def q_userbase_tree(spark, d):
    """SRC-1: files at different depths below one root."""
    root = stage_path(spark, "userbase")
    ub = cut_lineage(S.userbase(spark, d), "userbase")
    done = F.col("req_carrier_name") == "F"
    write_parquet(ub.where(done), f"{root}/part1/done")
    write_parquet(ub.where(~done), f"{root}/part2")
    return read_tree(spark, root, USERBASE).groupBy("req_con_type_desc", "req_carrier_name").agg(F.count(F.lit(1)).alias("n"))


def q_csv_by_name(spark, d):
    """SRC-5: declared columns out of a wider CSV whose columns stand in another order."""
    path = stage_path(spark, "supplier_csv")
    s = S.table(spark, d, "supplier")
    first = [c for c in s.columns if c not in ("s_suppkey", "s_name", "s_acctbal")]
    write_csv(s.select("s_acctbal", *first, "s_suppkey", F.lit("x").alias("extra"), "s_name"), path)
    types = {f.name: f for f in s.schema.fields}
    return read_csv_by_name(spark, path, StructType([types[c] for c in ("s_suppkey", "s_name", "s_acctbal")]))


def q_enrich_usage(spark, d):
    enriched = enrich_usage(S.usage_events(spark, d), S.userbase(spark, d), CFG.anchor_day)
    return enriched_daily_summary(enriched)


def q_usage_histogram(spark, d):
    return scoring.histogram_frame(scoring_inputs(spark, d), CFG)


def q_daily_usage(spark, d):
    return scoring.daily_frame(scoring_inputs(spark, d), CFG)


def q_rfm_base(spark, d):
    return rfm_base(q_daily_usage(spark, d))


def q_app_taxonomy(spark, d):
    return app_taxonomy(S.app_master(spark, d), S.app_level(spark, d), S.app_lifestage(spark, d))


def q_latest_device(spark, d):
    latest = latest_device(S.devices(spark, d), ("ifa", "month"))
    return latest.select("ifa", "month", "device.device_name", "device.device_model",
                         try_double(F.col("device.price")).alias("price"))


def q_priced_device(spark, d):
    return latest_prices(S.devices(spark, d), CFG.fx_rate, ("ifa", "month"))


def q_category_usage(spark, d):
    return category_usage(S.usage(spark, d), q_app_taxonomy(spark, d), CFG.category,
                          CFG.category_col, CFG.spend_excluded)


def q_monthly_spend(spark, d):
    return scoring.spend_frame(scoring_inputs(spark, d), CFG)


def q_peak_spend(spark, d):
    return peak_spend(q_monthly_spend(spark, d))


def q_rfm_measures(spark, d):
    return scoring.measures_frame(scoring_inputs(spark, d), CFG)


def _measures_ckpt(spark, d) -> DataFrame:
    return cut_lineage(q_rfm_measures(spark, d), "measures")


def q_dist_recency(spark, d):
    return scoring.distributions(q_rfm_measures(spark, d))["last_seen"]


def q_dist_frequency(spark, d):
    return scoring.distributions(q_rfm_measures(spark, d))["usage_frequency"]


def q_dist_monetary(spark, d):
    return scoring.distributions(q_rfm_measures(spark, d))["avg_spend"]


def q_report_csv_roundtrip(spark, d):
    """SNK-3/4 + SRC-5: a small report written as one CSV file with a header,
    read back with a declared schema (no inference pass)."""
    path = stage_path(spark, "r_dist")
    write_csv(q_dist_recency(spark, d), path, single_file=True)
    return read_csv_typed(spark, path, StructType([StructField("last_seen", IntegerType()),
                                                   StructField("ifa_count", LongType())]))


def q_report_overwrite(spark, d):
    """SNK-3: a report written over an earlier one."""
    path = stage_path(spark, "report")
    dist = cut_lineage(q_dist_recency(spark, d), "dist")
    write_csv(dist.withColumn("ifa_count", F.lit(0)), path, mode="overwrite")
    write_csv(dist, path, mode="overwrite", single_file=True)
    return read_csv_typed(spark, path, StructType([StructField("last_seen", IntegerType()),
                                                   StructField("ifa_count", LongType())]))


def q_report_order(spark, d):
    """SRT-1: the rows of the single-file report are in order."""
    path = stage_path(spark, "report")
    write_csv(q_dist_recency(spark, d), path, single_file=True)
    back = read_csv_typed(spark, path, StructType([StructField("last_seen", IntegerType()),
                                                   StructField("ifa_count", LongType())]))
    return back.select(F.monotonically_increasing_id().alias("pos"), "last_seen", "ifa_count")


def q_rfm_scores(spark, d):
    return rfm_scores(_measures_ckpt(spark, d), CFG.scale)


def q_percent_rank_scaled(spark, d):
    """EXT-1 alone over a whole raw table: price ascending, ship date descending."""
    li = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    ranked = percent_ranks(li, [RankSpec("l_extendedprice", False, "price_pct"),
                                RankSpec("l_shipdate", True, "ship_pct")])
    return ranked.select("l_orderkey", "l_linenumber", "price_pct", "ship_pct")


def q_percent_rank_signed(spark, d):
    """EXT-1 on a column with both zeros, which rank as one value."""
    x = F.when(F.col("l_linenumber") % 2 == 0, -F.col("l_discount")).otherwise(F.col("l_discount"))
    li = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"))
    return percent_ranks(li, [RankSpec("x", False, "pct")]).drop("x")


def q_percent_rank_text(spark, d):
    """EXT-1 on text with a long common prefix."""
    x = F.concat(F.lit("device-of-the-order-with-number-"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"))
    li = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"))
    return percent_ranks(li, [RankSpec("x", False, "pct")]).drop("x")


def q_uniqueness_check(spark, d):
    return uniqueness_check(q_rfm_scores(spark, d), "ifa")


def q_month_pruned_scan(spark, d):
    """SRC-2 on the raw table: month ranges pushed to the Parquet scan."""
    o = S.table(spark, d, "orders").where(months_predicate("o_orderdate", WINDOW_MONTHS))
    return (o.groupBy(F.date_format("o_orderdate", "yyyyMM").alias("month"))
            .agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("o_custkey").alias("devices")))


def q_monthly_roundtrip(spark, d):
    """SNK-1 month-partitioned write, SRC-2/3/8 pruned read of four months."""
    path = stage_path(spark, "usage_monthly")
    write_parquet(S.usage(spark, d), path, mode="overwrite", partition_by=["month"])
    back = explode_apps(read_monthly(spark, path, WINDOW_MONTHS), keep=["month"])
    return back.groupBy("month").agg(F.count(F.lit(1)).alias("rows"),
                                     F.countDistinct("ifa").alias("devices"),
                                     F.sum("brq_count").alias("brq"))


def q_legacy_month_scan(spark, d):
    """SRC-2 legacy glob + SRC-7/FN-5/6: month from each row's file path."""
    path = stage_path(spark, "usage_by_month")
    write_parquet(S.usage(spark, d), path, mode="overwrite", partition_by=["month"])
    raw = read_month_dirs(spark, path, WINDOW_MONTHS, dir_prefix="month=")
    back = explode_apps(raw, keep=["month"])
    return back.groupBy("month").agg(F.count(F.lit(1)).alias("rows"),
                                     F.countDistinct("ifa").alias("devices"),
                                     F.sum("brq_count").alias("brq"))


def q_spend_stream(spark, d):
    """Structured Streaming: usage and device snapshots land by month; the
    stream recomputes the months it sees (available-now trigger) and must
    equal the batch monthly spend."""
    from pyspark.sql.types import StringType
    from rfmlens.streaming import monthly_spend_stream
    usage_path, dev_path = stage_path(spark, "usage_in"), stage_path(spark, "devices_in")
    write_parquet(S.usage(spark, d), usage_path, mode="overwrite", partition_by=["month"])
    write_parquet(S.devices(spark, d), dev_path, mode="overwrite", partition_by=["month"])
    schema = spark.read.parquet(usage_path).schema
    schema = StructType([StructField(f.name, StringType()) if f.name == "month" else f for f in schema.fields])
    dev_schema = spark.read.parquet(dev_path).schema
    dev_schema = StructType([StructField(f.name, StringType()) if f.name == "month" else f
                             for f in dev_schema.fields])
    out = stage_path(spark, "spend_out")
    q = monthly_spend_stream(spark, usage_path, schema, dev_path, q_app_taxonomy(spark, d), out, CFG,
                             checkpoint=stage_path(spark, "spend_ckpt"), device_schema=dev_schema)
    q.awaitTermination()   # available-now: stops once caught up, raises if it failed
    return read_monthly(spark, out).select("ifa", "month", "spend")


def _wide(spark, d) -> DataFrame:
    """The wide per-device table, staged: the feature and k-means steps read
    it several times (scaler fit, layout size, fit, transform)."""
    wide = S.combined(spark, d, q_rfm_scores(spark, d), S.device_prices(spark, d))
    return cut_lineage(wide, "wide")


def _rule_clustered(spark, d) -> DataFrame:
    return S.recency_band(_wide(spark, d))


def q_features_scaled(spark, d):
    return scaled_columns(prepare_features(_wide(spark, d), FEATURES), FEATURES)


def q_feature_row_counts(spark, d):
    """AGG-12 + FLT-6: rows in, rows with all features, rows dropped."""
    wide = _rule_clustered(spark, d)
    prepared = prepare_features(wide, FEATURES)
    return row_reconciliation(wide, prepared)


def q_silhouette_given_labels(spark, d):
    prepared = prepare_features(_rule_clustered(spark, d), FEATURES)
    value = silhouette(prepared, prediction="cluster")
    return spark.createDataFrame([(round(value, 9),)], "silhouette double")


def q_silhouette_sweep(spark, d):
    return silhouette_sweep(prepare_features(_wide(spark, d), FEATURES), REFERENCE_SWEEP_KS)


def q_assign_clusters(spark, d):
    return assign_clusters(prepare_features(_wide(spark, d), FEATURES), k=6)


def q_kmeans_from_centres(spark, d):
    """ML-3: three Lloyd steps from the means of the rule-given segments."""
    prepared = cut_lineage(prepare_features(_rule_clustered(spark, d), FEATURES), "prepared")
    z = scaled_columns(prepared.select("ifa", "cluster", SCALED_COL), FEATURES, digits=None)
    z = z.join(prepared.select("ifa", "cluster"), "ifa")
    start = z.groupBy("cluster").agg(*[F.avg(f"z_{c}").alias(c) for c in FEATURES]).orderBy("cluster").collect()
    steps, _ = lloyd(prepared, [[r[c] for c in FEATURES] for r in start], 3)
    number = spark.createDataFrame([(i, r["cluster"]) for i, r in enumerate(start)], "centre int, cluster int")
    return steps.join(number, "centre").select(
        "cluster", F.col("n").alias("ifa_count"), *[F.round(f"z{i}", REPORT_DIGITS).alias(c) for i, c in enumerate(FEATURES)])


def q_assignment_check(spark, d):
    """ML-6, OP-16: every row has one label, that of the nearest returned centre."""
    prepared = cut_lineage(prepare_features(_wide(spark, d), FEATURES), "prepared")
    fit = fit_kmeans(prepared, 6)
    centres = sorted(tuple(map(float, c)) for c in fit.model.clusterCenters())   # labels are numbered in this order
    told = nearest(assign(prepared, fit, drop_vectors=False), centres)
    return told.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("ifa").alias("distinct_keys"),
                    F.count(F.when(F.col("cluster") != F.col("nearest"), 1)).alias("not_nearest"))


def q_choose_k(spark, d):
    """ML-7 on a sweep table made from the line items: the best k of at least 4."""
    sweep = S.table(spark, d, "lineitem").groupBy((F.col("l_linenumber") + 1).alias("k")).agg(
        F.round(F.avg("l_discount"), 9).alias("silhouette"))
    return spark.createDataFrame([(choose_k(sweep),)], "k int")


def q_kmeans_profile(spark, d):
    """The reference's clustering -> profiling chain: k-means labels (k=6),
    then means and sizes per cluster (rows only: k-means has no SQL form)."""
    model = cut_lineage(assign_clusters(prepare_features(_wide(spark, d), FEATURES), k=6), "kmeans")
    return round_doubles(cluster_means(model, MEANS_OF), REPORT_DIGITS)


def q_cluster_means(spark, d):
    return round_doubles(cluster_means(_rule_clustered(spark, d), MEANS_OF), REPORT_DIGITS)


def q_category_shares(spark, d):
    means = cluster_means(_rule_clustered(spark, d), MEANS_OF)
    return round_doubles(category_shares(means, SHARE_GROUPS), REPORT_DIGITS)


def q_band_values(spark, d):
    return band_values(_rule_clustered(spark, d), value="prediction")


def q_band_distribution(spark, d):
    return band_distribution(_rule_clustered(spark, d), value="prediction")


def q_mean_vs_median(spark, d):
    cols = ("avg_spend", "device_price")
    return round_doubles(mean_vs_median(_rule_clustered(spark, d), cols), REPORT_DIGITS,
                         skip=[f"median_{c}" for c in cols])


def q_audience_lists(spark, d):
    return audience_lists(_rule_clustered(spark, d))


def q_audience_parquet(spark, d):
    path = stage_path(spark, "audience_parquet")
    export_audiences(_rule_clustered(spark, d), path, "parquet")
    return spark.read.parquet(path)


def q_audience_csv(spark, d):
    path = stage_path(spark, "audience_csv")
    export_audiences(_rule_clustered(spark, d), path, "csv", label=REFERENCE_AUDIENCE_LABEL)
    return spark.read.option("header", "true").csv(path)


def q_audience_all(spark, d):
    return audience_all(_rule_clustered(spark, d))


def q_clustered_csv(spark, d):
    """SNK-5: the clustered table as CSV with a header, read back as text and cast."""
    path = stage_path(spark, "clustered_csv")
    write_csv(_rule_clustered(spark, d).drop("features", "standardized"), path)
    back = load_clustered(spark, path)
    return back.select(F.col("ifa").cast("bigint").alias("ifa"), "cluster", F.col("avg_spend").cast("double").alias("avg_spend"),
                       F.col("overall_brq").cast("bigint").alias("overall_brq"))


def q_median_exact(spark, d):
    """AGG-10 at any size: quartiles of whole raw columns by a column of few values."""
    return exact_quantiles(S.table(spark, d, "lineitem"), ("l_extendedprice", "l_quantity"), "l_returnflag",
                           (0.25, 0.5, 0.75), ("lower", "median", "upper"))


def q_global_row_number(spark, d):
    """JN-7, FN-18: positions over all rows and within a column of few values, without a window over them."""
    li = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    by = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"]
    over_all = global_row_number(li, by, out="pos")
    return global_row_number(over_all, by, within=["l_returnflag"], out="pos_in_flag").drop("l_extendedprice")


def q_kmeans_hashed(spark, d):
    """ML-3, OP-16: the fit that the clustering job runs, from its own start centres to the labels."""
    points = kmeans.points_of(_wide(spark, d), FEATURES)
    return kmeans.label(points, kmeans.fit(points, 6))


def q_sweep_from_centres(spark, d):
    """ML-4, ML-5, OP-15: every k from the same sequence of start centres, all in the same passes."""
    return kmeans.sweep(kmeans.points_of(_wide(spark, d), FEATURES), REFERENCE_SWEEP_KS).drop("steps")


def _mixed_devices(spark, d) -> str:
    """Snapshots by month, the price as text, double or decimal by month."""
    root = stage_path(spark, "devices_mixed")
    devices = S.devices(spark, d)
    kind = F.col("month").cast("int") % 3
    number = F.col("device.price").try_cast("double")
    for k, price in enumerate((F.col("device.price"), number, number.cast("decimal(18,2)"))):
        write_parquet(devices.where(kind == k).withColumn("device", F.col("device").withField("price", price)), root,
                      mode="append", partition_by=["month"])
    return root


def q_mixed_month_schemas(spark, d):
    """SRC-2, SRC-4: months whose files hold the price in different types."""
    return latest_prices(read_monthly(spark, _mixed_devices(spark, d), schema=S.devices(spark, d).schema), CFG.fx_rate, ("ifa", "month"))


def q_spend_stream_mixed(spark, d):
    """The monthly stream over snapshots of mixed types, and with months that lose their spend: a snapshot that came first and
    is replaced by a later one without a price must leave nothing behind."""
    from rfmlens.streaming import monthly_spend_stream
    usage_path, dev_path = stage_path(spark, "usage_in"), _mixed_devices(spark, d)
    usage, devices = S.usage(spark, d), S.devices(spark, d)
    write_parquet(usage, usage_path, mode="overwrite", partition_by=["month"])
    out, ckpt = stage_path(spark, "spend_out"), stage_path(spark, "spend_ckpt")
    early = devices.withColumns({"device": F.col("device").withField("price", F.lit("1.0")),
                                 "snapshot_ts": F.col("snapshot_ts") - F.expr("interval 1 hour")}).where("month < '199401'")
    early_path = stage_path(spark, "devices_early")
    write_parquet(early, early_path, mode="overwrite", partition_by=["month"])

    def run(path: str, checkpoint: str) -> None:
        monthly_spend_stream(spark, usage_path, usage.schema, path, q_app_taxonomy(spark, d), out, CFG, checkpoint=checkpoint,
                             device_schema=devices.schema).awaitTermination()

    run(early_path, stage_path(spark, "spend_ckpt"))
    run(dev_path, ckpt)
    return read_monthly(spark, out).select("ifa", "month", "spend")


def q_rank_after_delta(spark, d):
    """WIN-3..6 incrementally: the stored histogram of the earlier months' peaks and the signed counts of the devices that the last
    three months change."""
    spend = cut_lineage(q_monthly_spend(spark, d), "spend")
    months = sorted(r[0] for r in spend.select("month").distinct().collect())   # calendar months
    late = F.col("month") >= F.lit(months[-3:][0] if months else "")
    spec = RankSpec("spend", False, "pct", keep_nulls=False)
    stored = cut_lineage(peak_spend(spend.where(~late)), "peaks")
    counts = cut_lineage(value_counts(stored, spec), "peak_counts")
    changed = spend.where(late).select("ifa").distinct()
    come = cut_lineage(peak_spend(spend.join(changed, "ifa", "left_semi")), "new_peaks")
    counts = changed_counts(counts, stored.join(changed, "ifa", "left_semi"), come, spec)
    now = stored.join(changed, "ifa", "left_anti").unionByName(come)
    return ranks_from_counts(now, [(spec, cut_lineage(counts, "peak_counts"))])


def q_rfm_base_incremental(spark, d):
    """AGG-5, OP-8 as state by device and month: a month that came in part is corrected, a late one added, a wrong one emptied."""
    state = stage_path(spark, "rfm_months")
    daily = cut_lineage(q_daily_usage(spark, d), "daily")
    month = F.date_format("date", "yyyyMM")
    months = sorted(r[0] for r in daily.select(month).distinct().collect())   # calendar months
    part = daily.where((month != F.lit(months[-2])) | (F.col("ifa") % 2 == 0))
    wrong = daily.where(month == F.lit(months[0])).withColumn("date", F.lit("1900-01-31").cast("date"))
    refresh_rfm_months(state, part.unionByName(wrong), [*months[:-1], "190001"])
    refresh_rfm_months(state, daily, months[-2:])
    refresh_rfm_months(state, daily, ["190001"])
    return rfm_base_of(spark.read.parquet(state).drop("month"))


AUDIENCE_ROWS = 40


def q_audience_files(spark, d):
    """SNK-6, SNK-7: files of a given number of ids, counted from the files themselves."""
    path = stage_path(spark, "audience_files")
    export_audiences(_rule_clustered(spark, d), path, "csv", label=REFERENCE_AUDIENCE_LABEL, rows_per_file=AUDIENCE_ROWS)
    # With a declared schema the files are listed once; inferring one lists each file again.
    ids = StructType([StructField(REFERENCE_AUDIENCE_LABEL, StringType()), StructField("cluster", IntegerType())])
    rows = spark.read.schema(ids).option("header", "true").csv(path).select("cluster", F.col("_metadata.file_path").alias("f"))
    per_file = rows.groupBy("cluster", "f").agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy("cluster").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("rows"), F.max("n").alias("most"))


def q_enrich_usage_colocated(spark, d):
    """JN-1, OP-1 for the monthly job: usage and userbase counts stored in buckets of the device, joined without an exchange."""
    usage = store_by_key(S.usage_events(spark, d), "ifa", 16, "usage_by_device")
    links = store_by_key(channel_links(S.userbase(spark, d), name="ub_rows"), "ifa", 16, "links_by_device")
    return enriched_daily_summary(with_usage_dates(join_stored(spark, usage, links), CFG.anchor_day))


def q_distinct_sketches(spark, d):
    """AGG-1, AGG-6, AGG-13 mergeable: devices of each year from stored monthly sketches, held against the exact count."""
    o = S.table(spark, d, "orders").select(F.col("o_custkey").alias("ifa"), F.date_format("o_orderdate", "yyyyMM").alias("month"))
    stored = cut_lineage(key_sketches(o, ["month"]), "sketches").withColumn("year", F.substring("month", 1, 4))
    exact = o.groupBy(F.substring("month", 1, 4).alias("year")).agg(F.countDistinct("ifa").alias("devices"))
    near = F.abs(F.col("n_keys") - F.col("devices")) <= 0.03 * F.col("devices")
    return merged_counts(stored, ["year"]).join(exact, "year").select("year", "devices", near.alias("within_3_percent"))


def q_profile_order(spark, d):
    """SRT-2, SRT-3: positions of the segments in the written profiles."""
    model = _rule_clustered(spark, d)
    out = None
    for name, profile in (("means", cluster_means(model, ("r",))), ("bands", band_distribution(model, value="prediction")),
                          ("medians", mean_vs_median(model, ("avg_spend",)))):
        path = stage_path(spark, f"profile_{name}")
        write_csv(profile.select("cluster"), path, single_file=True)
        back = read_csv_typed(spark, path, StructType([StructField("cluster", IntegerType())])).select(
            F.lit(name).alias("profile"), F.monotonically_increasing_id().alias("pos"), "cluster")
        out = back if out is None else out.unionByName(back)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "explode_usage": q_explode_usage,
    "explode_star": q_explode_star,
    "explode_cross": q_explode_cross,
    "userbase_tree": q_userbase_tree,
    "csv_by_name": q_csv_by_name,
    "enrich_usage": q_enrich_usage,
    "usage_histogram": q_usage_histogram,
    "daily_usage": q_daily_usage,
    "rfm_base": q_rfm_base,
    "app_taxonomy": q_app_taxonomy,
    "latest_device": q_latest_device,
    "priced_device": q_priced_device,
    "category_usage": q_category_usage,
    "monthly_spend": q_monthly_spend,
    "peak_spend": q_peak_spend,
    "spend_stream": q_spend_stream,
    "rfm_measures": q_rfm_measures,
    "dist_recency": q_dist_recency,
    "dist_frequency": q_dist_frequency,
    "dist_monetary": q_dist_monetary,
    "report_csv_roundtrip": q_report_csv_roundtrip,
    "report_overwrite": q_report_overwrite,
    "report_order": q_report_order,
    "rfm_scores": q_rfm_scores,
    "uniqueness_check": q_uniqueness_check,
    "percent_rank_scaled": q_percent_rank_scaled,
    "percent_rank_signed": q_percent_rank_signed,
    "percent_rank_text": q_percent_rank_text,
    "month_pruned_scan": q_month_pruned_scan,
    "monthly_roundtrip": q_monthly_roundtrip,
    "legacy_month_scan": q_legacy_month_scan,
    "features_scaled": q_features_scaled,
    "feature_row_counts": q_feature_row_counts,
    "silhouette_given_labels": q_silhouette_given_labels,
    "silhouette_sweep": q_silhouette_sweep,
    "assign_clusters": q_assign_clusters,
    "kmeans_from_centres": q_kmeans_from_centres,
    "assignment_check": q_assignment_check,
    "choose_k": q_choose_k,
    "kmeans_profile": q_kmeans_profile,
    "cluster_means": q_cluster_means,
    "category_shares": q_category_shares,
    "band_values": q_band_values,
    "band_distribution": q_band_distribution,
    "mean_vs_median": q_mean_vs_median,
    "audience_lists": q_audience_lists,
    "audience_all": q_audience_all,
    "clustered_csv": q_clustered_csv,
    "audience_parquet": q_audience_parquet,
    "audience_csv": q_audience_csv,
    "median_exact": q_median_exact,
    "global_row_number": q_global_row_number,
    "kmeans_hashed": q_kmeans_hashed,
    "sweep_from_centres": q_sweep_from_centres,
    "mixed_month_schemas": q_mixed_month_schemas,
    "spend_stream_mixed": q_spend_stream_mixed,
    "rank_after_delta": q_rank_after_delta,
    "rfm_base_incremental": q_rfm_base_incremental,
    "audience_files": q_audience_files,
    "enrich_usage_colocated": q_enrich_usage_colocated,
    "distinct_sketches": q_distinct_sketches,
    "profile_order": q_profile_order,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
