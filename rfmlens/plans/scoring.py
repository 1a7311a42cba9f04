"""Entry A: usage -> daily use -> RFM base; devices + category usage -> spend;
measures -> percent-rank scores. One Spark plan per output, months as a key.

The reference hands stages over through Parquet files and loops over months
on the driver; here the months are a key column (EXT-3), stages are plain
DataFrames, and only the measures frame -- read by four rankings and three
distributions -- is cut from its lineage with a reliable checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rfmlens import schemas
from rfmlens.config import ScoringConfig
from rfmlens.operators.checks import uniqueness_check
from rfmlens.operators.rfm import rfm_base, rfm_measures, rfm_scores, value_distribution
from rfmlens.operators.spend import category_usage, latest_prices, monthly_spend, peak_spend
from rfmlens.functions.dates import usage_day
from rfmlens.operators.taxonomy import app_taxonomy, sized
from rfmlens.operators.usage import (channel_links, daily_from_day_sums, daily_usage, explode_apps,
                                     usage_histogram, with_usage_dates)
from rfmlens.session import cut_lineage
from rfmlens.sources.readers import read_csv_by_name, read_monthly, read_tree
from rfmlens.sources.sinks import count_rows, write_csv, write_parquet


@dataclass
class ScoringInputs:
    userbase: DataFrame       # ifa, req_con_type_desc, req_carrier_name
    usage: DataFrame          # ifa, app array<struct>, connection array<struct>, month
    devices: DataFrame        # ifa, device struct, month, snapshot_ts, record_id
    app_master: DataFrame
    app_level: DataFrame
    app_lifestage: DataFrame


def load_inputs(spark: SparkSession, userbase_path: str, usage_root: str, devices_root: str,
                master_csv: str, level_csv: str, lifestage_csv: str,
                months: Sequence[str] | None = None) -> ScoringInputs:
    """Inputs from storage with declared schemas: userbase Parquet (any depth),
    usage and device snapshots partitioned by ``month=yyyyMM`` (pruned to
    ``months``), app reference tables as header CSV."""
    return ScoringInputs(
        userbase=read_tree(spark, userbase_path, schemas.USERBASE),
        usage=read_monthly(spark, usage_root, months, schemas.USAGE),
        devices=read_monthly(spark, devices_root, months, schemas.DEVICE),
        app_master=read_csv_by_name(spark, master_csv, schemas.APP_MASTER),
        app_level=read_csv_by_name(spark, level_csv, schemas.APP_LEVEL),
        app_lifestage=read_csv_by_name(spark, lifestage_csv, schemas.APP_LIFESTAGE))


def daily_frame(inp: ScoringInputs, cfg: ScoringConfig) -> DataFrame:
    events = explode_apps(inp.usage, cfg.key)
    return daily_usage(events, inp.userbase, cfg.anchor_day, cfg.daily_excluded, cfg.key)


def spend_frame(inp: ScoringInputs, cfg: ScoringConfig) -> DataFrame:
    """Monthly spend for all months in one plan (the reference's month loop)."""
    taxonomy = app_taxonomy(inp.app_master, inp.app_level, inp.app_lifestage)
    priced = latest_prices(inp.devices, cfg.fx_rate, (cfg.key, "month"))
    streaming = category_usage(inp.usage, taxonomy, cfg.category, cfg.category_col,
                               cfg.spend_excluded, cfg.key)
    return monthly_spend(priced, streaming, cfg.key)


def usage_sums(inp: ScoringInputs, cfg: ScoringConfig) -> tuple[DataFrame, DataFrame]:
    """Both usage aggregates from ONE scan of the nested usage table.

    Daily use needs sum(count) per (device, day) over every app; category
    spend needs sum(count x allowed connections x category rows) per
    (device, month). Reading the usage table once and aggregating with
    GROUPING SETS ((device, day), (device, month)) gives both with one
    shuffle -- at scale the usage scan is the dominant cost. Runs one job
    (the staged sums). The category's
    bundles are joined as (bundle, taxonomy rows), so a
    duplicated taxonomy row multiplies category usage as the reference's left
    join does without duplicating rows for daily use.
    """
    k = cfg.key
    taxonomy = app_taxonomy(inp.app_master, inp.app_level, inp.app_lifestage)
    cat = (taxonomy.where(F.col(cfg.category_col) == F.lit(cfg.category))
           .groupBy("bundle").agg(F.count(F.lit(1)).alias("__n_cat")))
    cat = sized(cat, "category_bundles")
    allowed = F.filter(F.col("connection"), lambda c: c["req_con_type_desc"].isNotNull()
                       & ~c["req_con_type_desc"].isin(list(cfg.spend_excluded)))
    weight = F.when(F.col("connection").isNull(), F.lit(0)).otherwise(F.size(allowed))
    rows = (inp.usage.select(k, "month", weight.alias("__w"), F.explode("app").alias("__a"))
            .select(k, "month", "__w", F.col("__a.bundle").alias("bundle"),
                    F.col("__a.brq_count").alias("brq_count"),
                    usage_day(F.col("__a.last_seen")).alias("date"))
            .join(cat, "bundle", "left"))
    in_cat = F.col("__n_cat").isNotNull() & (F.col("__w") > 0)
    sums = (rows.groupingSets([[k, "date"], [k, "month"]], k, "date", "month")
            .agg(F.sum("brq_count").alias("_day_sum"),
                 F.sum(F.when(in_cat, F.col("brq_count") * F.col("__w") * F.col("__n_cat")))
                 .alias("data_streaming"),
                 F.count(F.when(in_cat, F.lit(1))).alias("__cat_rows"),
                 F.grouping("month").alias("__g_month")))
    # Each consumer needs different columns, so Catalyst would prune the two
    # branches differently and scan usage twice; staging the (small, day- and
    # month-grain) result once keeps it at one scan.
    sums = cut_lineage(sums, "usage_sums")
    per_day = sums.where(F.col("__g_month") == 1).select(k, "date", "_day_sum")
    streaming = (sums.where((F.col("__g_month") == 0) & (F.col("__cat_rows") > 0))
                 .select(k, "month", "data_streaming"))
    return per_day, streaming


def measures_frame(inp: ScoringInputs, cfg: ScoringConfig, fused: bool = False) -> DataFrame:
    """RFM measures. ``fused=True`` reads the usage table once for both the
    daily and the spend side (``usage_sums``: one scan, grouping sets, one
    staging job) -- for deployments where scanning usage is I/O-bound (object
    storage). The default reads it twice: measured faster when scans are
    """
    if not fused:
        base = rfm_base(daily_frame(inp, cfg), cfg.key)
        return rfm_measures(base, peak_spend(spend_frame(inp, cfg), cfg.key), cfg.key)
    per_day, streaming = usage_sums(inp, cfg)
    daily = daily_from_day_sums(per_day, inp.userbase, cfg.anchor_day, cfg.daily_excluded, cfg.key)
    priced = latest_prices(inp.devices, cfg.fx_rate, (cfg.key, "month"))
    spend = monthly_spend(priced, streaming, cfg.key)
    return rfm_measures(rfm_base(daily, cfg.key), peak_spend(spend, cfg.key), cfg.key)


def scores_frame(inp: ScoringInputs, cfg: ScoringConfig, checkpoint: bool = True) -> DataFrame:
    measures = measures_frame(inp, cfg)
    if checkpoint:
        measures = cut_lineage(measures, "measures")
    return rfm_scores(measures, cfg.scale)


def histogram_frame(inp: ScoringInputs, cfg: ScoringConfig) -> DataFrame:
    return usage_histogram(explode_apps(inp.usage, cfg.key), inp.userbase, cfg.key)


def distributions(measures: DataFrame, key: str = "ifa") -> dict[str, DataFrame]:
    """OP-11 x 3 over ``rfm_measures`` output (one row per key by construction)."""
    return {m: value_distribution(measures, m, key, unique_keys=True)
            for m in ("last_seen", "usage_frequency", "avg_spend")}


def spend_of(inp: ScoringInputs, streaming: DataFrame, cfg: ScoringConfig) -> DataFrame:
    """Monthly spend from the category sums of ``usage_sums``."""
    return monthly_spend(latest_prices(inp.devices, cfg.fx_rate, (cfg.key, "month")), streaming, cfg.key)


def run(inp: ScoringInputs, cfg: ScoringConfig, out_root: str, mode: str = "overwrite",
        single_file_reports: bool = False) -> DataFrame:
    """The whole scoring job with the reference's outputs.

    Usage is read twice: for the day and category sums (``usage_sums``), and
    for the histogram. The monthly spend is computed once, written, and
    read back for the measures, as in the reference.

    Writes: ``main_df`` in its factorised form (usage counts of userbase
    devices per device and day with the number of userbase rows), ``userbase``
    links, the usage histogram and the three distributions (CSV; one file each
    only if ``single_file_reports``), monthly spend (Parquet by month), the
    scores (Parquet) and ``checks`` (row counts and key uniqueness).
    Returns the scores read back from their written location.
    """
    spark = inp.usage.sparkSession
    key = cfg.key
    # scan 1: day sums and category sums
    per_day, streaming = usage_sums(inp, cfg)
    # scan 2: distinct (device, count) pairs
    write_csv(histogram_frame(inp, cfg), f"{out_root}/brq_count", mode=mode, single_file=single_file_reports)
    links = channel_links(inp.userbase, key, name="ub_rows")
    write_parquet(with_usage_dates(per_day.join(links, key, "inner"), cfg.anchor_day, "date"),
                  f"{out_root}/main_df", mode=mode)
    write_parquet(spend_of(inp, streaming, cfg), f"{out_root}/spend_df", mode=mode, partition_by=["month"])
    spend = read_monthly(spark, f"{out_root}/spend_df")
    daily = daily_from_day_sums(per_day, inp.userbase, cfg.anchor_day, cfg.daily_excluded, key)
    measures = cut_lineage(rfm_measures(rfm_base(daily, key), peak_spend(spend, key), key), "measures")
    for name, dist in distributions(measures, key).items():
        write_csv(dist, f"{out_root}/dist_{name}", mode=mode, single_file=single_file_reports)
    write_parquet(rfm_scores(measures, cfg.scale), f"{out_root}/output_rfm", mode=mode)
    scores = spark.read.parquet(f"{out_root}/output_rfm")
    write_parquet(uniqueness_check(scores, key).withColumn("measures", F.lit(count_rows(measures))),
                  f"{out_root}/checks", mode=mode)
    return scores
