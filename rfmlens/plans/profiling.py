"""Entry C: profiles of a clustered table and the audience exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from rfmlens.config import REFERENCE_AUDIENCE_LABEL
from rfmlens.operators.audience import audience_all, audience_lists, export_audiences
from rfmlens.operators.profile import (band_distribution, category_shares, cluster_means,
                                       mean_vs_median)
from rfmlens.sources.sinks import write_csv, write_parquet


def load_clustered(spark, path: str, cluster: str = "cluster", prediction: str = "prediction") -> DataFrame:
    """A clustered table written as header CSV (all strings): the k-means
    label column becomes an int ``cluster`` so segments sort numerically
    (as text, ``'10' < '2'``); other columns are cast where they are used."""
    df = spark.read.option("header", "true").csv(path)
    if prediction in df.columns and cluster not in df.columns:
        df = df.withColumnRenamed(prediction, cluster)
    return df.withColumn(cluster, F.col(cluster).try_cast("double").cast("int"))


def round_doubles(df: DataFrame, digits: int, skip: Sequence[str] = ()) -> DataFrame:
    """Round floating columns (report presentation; also makes results
    independent of the summation order of a distributed average). Columns in
    ``skip`` (exact values such as medians) are left as they are."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) and f.name not in skip
        else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def profile_report(model: DataFrame, means_of: Sequence[str],
                   share_groups: Mapping[str, Sequence[str]], cluster: str = "cluster",
                   key: str = "ifa") -> dict[str, DataFrame]:
    means = cluster_means(model, means_of, cluster, key)
    return {
        "means": means,
        "shares": category_shares(means, share_groups),
        "bands": band_distribution(model, cluster=cluster, key=key),
        "median": mean_vs_median(model, ("avg_spend", "device_price"), cluster),
        "audiences": audience_lists(model, cluster, key),
    }


def export(model: DataFrame, root: str, cluster: str = "cluster", key: str = "ifa",
           label: str = REFERENCE_AUDIENCE_LABEL, mode: str = "errorifexists") -> None:
    """Parquet list per segment and overall, CSV copies with the id header."""
    export_audiences(model, f"{root}/parquet", "parquet", mode, cluster, key)
    export_audiences(model, f"{root}/csv", "csv", mode, cluster, key, label)
    everyone = audience_all(model, key)
    write_parquet(everyone, f"{root}/all/parquet", mode)
    write_csv(everyone.withColumnRenamed(key, label), f"{root}/all/csv", mode)


def run(model: DataFrame, out_root: str, means_of: Sequence[str],
        share_groups: Mapping[str, Sequence[str]], cluster: str = "cluster", key: str = "ifa",
        mode: str = "overwrite") -> dict[str, DataFrame]:
    """Profiles written as small CSV reports, plus the audience exports."""

    report = profile_report(model, means_of, share_groups, cluster, key)
    for name in ("means", "shares", "bands", "median"):
        write_csv(report[name], f"{out_root}/{name}", mode=mode, single_file=True)
    export(model, f"{out_root}/ifa_list", cluster, key, mode=mode)
    return report
