"""Segment profiles (OP-17, OP-18, OP-19, OP-22).

Each profile is a single aggregate over the clustered table grouped by the
segment: the partial aggregate runs before the shuffle, so a segment holding
a third of all devices costs no more than any other. The reference computes
means and sizes separately and joins them (JN-8, JN-9) and joins a median back
onto every row (JN-10); here they are columns of the same aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rfmlens.config import REFERENCE_AGE_BANDS
from rfmlens.functions.scalar import band_of, safe_ratio, try_double
from rfmlens.operators.quantiles import exact_quantiles


def cluster_means(model: DataFrame, columns: Sequence[str], cluster: str = "cluster",
                  key: str = "ifa") -> DataFrame:
    """OP-17 (AGG-7, PRJ-7, AGG-8, JN-8): mean of each column and segment size."""
    aggs = [F.avg(try_double(F.col(f"`{c}`"))).alias(c) for c in columns]
    return (model.groupBy(cluster).agg(*aggs, F.count(key).alias("ifa_count"))
            .orderBy(cluster))


def category_shares(means: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """OP-18 (FN-14): each member column divided by its group total column.

    A ratio of means, as in the reference (not a mean of ratios); a zero
    total gives null instead of an ANSI division error.
    """
    total_of = {c.lower(): total for total, members in groups.items() for c in members}
    return means.select(*[
        safe_ratio(F.col(f"`{c}`"), F.col(f"`{total_of[c.lower()]}`")).alias(c) if c.lower() in total_of else F.col(f"`{c}`")
        for c in means.columns])


def band_values(model: DataFrame, value: str = "age",
                bands: Sequence[tuple[float, str]] = REFERENCE_AGE_BANDS, out: str = "age") -> DataFrame:
    """FN-15 + PRJ-10: the distinct band labels present (null for unmapped)."""
    return model.select(band_of(try_double(F.col(f"`{value}`")), bands).alias(out)).distinct()


def band_distribution(model: DataFrame, value: str = "age",
                      bands: Sequence[tuple[float, str]] = REFERENCE_AGE_BANDS,
                      cluster: str = "cluster", key: str = "ifa",
                      fill_zero: bool = False) -> DataFrame:
    """OP-19 (FN-15, AGG-9, JN-9): devices per band and segment, plus size.

    The pivot over explicit band labels is a conditional count inside the
    same aggregate as the size (no job to discover pivot values, no join).
    As with ``pivot``, a band absent from a segment is null unless
    ``fill_zero``; values outside the bands are counted in no band column.
    """
    label = band_of(try_double(F.col(value)), bands)
    counted = []
    for _, name in bands:
        n = F.count(F.when(label == F.lit(name), F.lit(1)))
        counted.append((n if fill_zero else F.nullif(n, F.lit(0))).alias(name))
    return (model.groupBy(cluster).agg(*counted, F.count(key).alias("ifa_count"))
            .orderBy(cluster))


def mean_vs_median(model: DataFrame, columns: Sequence[str], cluster: str = "cluster",
                   accuracy: int | None = None) -> DataFrame:
    """OP-22 (AGG-10, AGG-11, JN-10): mean and median per segment.

    The median is an element of the data (the lower middle for even counts)
    and exact whatever the segment's size (``operators.quantiles``). With
    ``accuracy`` it is Spark's ``percentile_approx``, as in the reference: one
    aggregate, exact up to ``accuracy`` rows per segment.
    """
    mean = {c: F.avg(try_double(F.col(f"`{c}`"))).alias(f"mean_{c}") for c in columns}
    if accuracy:
        out = model.groupBy(cluster).agg(*mean.values(), *[
            F.percentile_approx(try_double(F.col(f"`{c}`")), 0.5, accuracy).alias(f"median_{c}") for c in columns])
    else:
        medians = exact_quantiles(model, columns, cluster).withColumnRenamed(cluster, "__segment")
        means = model.groupBy(cluster).agg(*mean.values())   # a row per segment on both sides
        out = means.join(medians, F.col(f"`{cluster}`").eqNullSafe(F.col("__segment")))
    cells = [F.col(f"{kind}_{c}") for c in columns for kind in ("mean", "median")]
    ratios = [safe_ratio(F.col(f"mean_{c}"), F.col(f"median_{c}")).alias(f"mean_to_median_{c}") for c in columns]
    return out.select(cluster, *cells, *ratios).orderBy(cluster)
