"""RFM operators: OP-8 base, OP-10 measures, OP-11 distributions, OP-12 scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rfmlens.operators.rank import RankSpec, percent_ranks
from rfmlens.session import cut_lineage
from rfmlens.sources.sinks import write_parquet


MEASURE_COLUMNS = ("last_seen", "usage_frequency", "brq_frequency", "data_usage_freq",
                   "avg_spend", "brq_count")


def rfm_base(daily: DataFrame, key: str = "ifa") -> DataFrame:
    """OP-8 (AGG-5 + FN-10): first/last activity, active days, usage, span in months."""
    return (daily.groupBy(key).agg(
        F.min("date").alias("earliest_date"),
        F.max("date").alias("latest_date"),
        F.max("days_since").alias("first_seen"),
        F.min("days_since").alias("last_seen"),
        F.min("period_months").alias("min_period"),
        F.max("period_months").alias("max_period"),
        F.count("date").alias("data_usage_freq"),
        F.sum("sum_brq_daily").alias("brq_count"))
        .withColumn("duration_months", F.col("max_period") - F.col("min_period") + F.lit(1)))


def rfm_months(daily: DataFrame, key: str = "ifa") -> DataFrame:
    """AGG-5 as keyed state: one row for each device and month of its days, from which ``rfm_base_of`` gives the base.

    A day lies in one month, so a month's rows replace each other as a whole: a late or
    corrected month is recomputed and overwritten alone, and extremes stay right when its days disappear, which
    no running minimum could undo.
    """
    return daily.groupBy(key, F.date_format("date", "yyyyMM").alias("month")).agg(
        F.min("date").alias("earliest_date"), F.max("date").alias("latest_date"),
        F.max("days_since").alias("first_seen"), F.min("days_since").alias("last_seen"),
        F.min("period_months").alias("min_period"), F.max("period_months").alias("max_period"),
        F.count("date").alias("data_usage_freq"), F.sum("sum_brq_daily").alias("brq_count"))


def rfm_base_of(months: DataFrame, key: str = "ifa") -> DataFrame:
    """OP-8 from the state of ``rfm_months``: the same rows as ``rfm_base`` of all days."""
    return (months.groupBy(key).agg(
        F.min("earliest_date").alias("earliest_date"), F.max("latest_date").alias("latest_date"),
        F.max("first_seen").alias("first_seen"), F.min("last_seen").alias("last_seen"),
        F.min("min_period").alias("min_period"), F.max("max_period").alias("max_period"),
        F.sum("data_usage_freq").alias("data_usage_freq"), F.sum("brq_count").alias("brq_count"))
        .withColumn("duration_months", F.col("max_period") - F.col("min_period") + F.lit(1)))


def refresh_rfm_months(state_path: str, daily: DataFrame, months: Sequence[str], key: str = "ifa") -> None:
    """Replace the ``months`` (yyyyMM) of the stored state by those of ``daily``, which holds all days of these months.

    A month without days any more is emptied; other months are neither read nor written.
    """
    spark = daily.sparkSession
    wanted = [str(m) for m in months]
    new = cut_lineage(rfm_months(daily, key).where(F.col("month").isin(wanted)), "rfm_months")
    write_parquet(new, state_path, mode="overwrite", partition_by=["month"])
    # Dynamic overwrite only replaces months with rows.
    kept = {r[0] for r in new.select("month").distinct().collect()}   # months, of those asked for
    for month in sorted(set(wanted) - kept):
        spark.createDataFrame([], new.drop("month").schema).coalesce(1).write.mode("overwrite").parquet(f"{state_path.rstrip('/')}/month={month}")


def rfm_measures(base: DataFrame, spend: DataFrame, key: str = "ifa", how: str = "inner") -> DataFrame:
    """OP-10 (JN-6, FN-11, FN-12): per-month rates and rounded average spend.

    Inner join by default: only devices with a spend keep a measure; ``how=
    "left"`` keeps every active device with a null spend (SURVEY T4). Both inputs are
    aggregated by ``key`` with the session's shuffle partitioning, so the join
    reuses that partitioning instead of shuffling again.
    """
    d = F.col("duration_months")
    return (base.join(spend, key, how)
            .select(key, "last_seen",
                    (F.col("data_usage_freq") / d).alias("usage_frequency"),
                    (F.col("brq_count") / d).alias("brq_frequency"),
                    "data_usage_freq",
                    F.round(F.col("spend") / d).alias("avg_spend"),
                    "brq_count"))


def value_distribution(measures: DataFrame, measure: str, key: str = "ifa",
                       unique_keys: bool = False) -> DataFrame:
    """OP-11 (AGG-6 + SRT-1): distinct devices per value of one measure, by value.

    ``unique_keys=True`` declares one row per key (true of ``rfm_measures``
    output, grouped by key and joined 1:1), so a plain count gives the same
    number as ``countDistinct`` without its extra shuffle of (value, key)
    pairs -- the redundant-distinct removal Catalyst cannot do for lack of
    key metadata.
    """
    n = F.count(key) if unique_keys else F.countDistinct(key)
    return measures.groupBy(measure).agg(n.alias("ifa_count")).orderBy(F.col(measure).asc())


# Score columns: (prefix, measure, descending). Recency ranks descending days,
# so the most recent device has the highest score.
SCORE_SPECS = (("r", "last_seen", True),
               ("vf", "usage_frequency", False),
               ("bf", "brq_frequency", False),
               ("m", "avg_spend", False))


def rfm_scores(measures: DataFrame, scale: float = 5.0, buckets: int | None = None,
               rank_nulls: bool = False) -> DataFrame:
    """OP-12 (WIN-3..6 via EXT-1, FN-13): four percentiles and 0..scale scores.

    A null measure gets a null score and is not counted (SURVEY T14: in the
    reference's descending recency window a null would rank best);
    ``rank_nulls=True`` ranks nulls exactly as the window does. Runs two small
    aggregate jobs eagerly; stage ``measures`` first when it is expensive
    (the scoring plan does).
    """
    specs = [RankSpec(col, desc, f"{p}_percentile", keep_nulls=rank_nulls)
             for p, col, desc in SCORE_SPECS]
    ranked = percent_ranks(measures, specs, buckets=buckets)
    cols = list(measures.columns)
    return ranked.select(*cols,
                         *[F.col(f"{p}_percentile") for p, _, _ in SCORE_SPECS],
                         *[(F.col(f"{p}_percentile") * F.lit(float(scale))).alias(p)
                           for p, _, _ in SCORE_SPECS])
