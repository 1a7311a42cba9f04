"""Feature preparation and k-means (OP-14, OP-15, OP-16, ML-1..7, EXT-2).

Distributed MLlib estimators; nothing is collected except the fitted model
(k centres) and one silhouette number per fit.

EXT-2, repeatable k-means: k-means|| sampling depends on how rows are laid out
in partitions, so the same rows under a different partitioning can converge
to a different local optimum. Before fitting, rows are hash partitioned by
the device key into a given number of partitions and
sorted by key inside each, which makes the layout a function of the data
and that parameter. Several seeds can
be tried (lowest training cost wins) and clusters are renumbered by the
lexicographic order of their centres so labels mean the same between runs.
The device key is carried through ``transform`` instead of re-attaching
predictions by a generated row id (JN-7).
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rfmlens.config import DEFAULT_SEED

FEATURES_COL = "features"
SCALED_COL = "standardized"


def prepare_features(df: DataFrame, features: Sequence[str], key: str = "ifa",
                     keep: Sequence[str] | None = None, rename: dict | None = None,
                     with_mean: bool = False, with_std: bool = True) -> DataFrame:
    """OP-14: cast to float, drop incomplete rows, assemble, scale (no centring).

    ``try_cast`` first, then the null drop, so unparsable values remove the row
    instead of failing the assembler (FLT-6, PRJ-8, ML-1, ML-2, PRJ-6).
    ``keep`` columns ride along unchanged (all other columns by default).
    ``rename`` maps feature names for the output frame; by default the age
    class ``prediction`` becomes ``age`` because k-means writes ``prediction``.
    The scaler defaults are the reference's (no centring, unit sample
    standard deviation, SURVEY T16).
    """
    features = list(features)
    clean = complete_features(df, features, key, keep)
    assembled = VectorAssembler(inputCols=features, outputCol=FEATURES_COL).transform(clean)
    scaler = StandardScaler(inputCol=FEATURES_COL, outputCol=SCALED_COL,
                            withMean=with_mean, withStd=with_std).fit(assembled)
    return renamed_features(scaler.transform(assembled), rename)


def complete_features(df: DataFrame, features: Sequence[str], key: str = "ifa",
                      keep: Sequence[str] | None = None) -> DataFrame:
    """FLT-6, PRJ-8: features as floats, rows that lack one dropped; ``keep`` columns (all others by default) unchanged."""
    keep = [c for c in (keep if keep is not None else df.columns) if c not in features and c != key]
    casted = df.select(key, *keep, *[F.col(c).try_cast("float").alias(c) for c in features])
    return casted.na.drop(subset=list(features))


def renamed_features(df: DataFrame, rename: dict | None = None) -> DataFrame:
    """PRJ-6: by default the age class ``prediction`` becomes ``age``."""
    rename = {"prediction": "age"} if rename is None else rename
    return df.withColumnsRenamed({old: new for old, new in rename.items() if old in df.columns})


def scaled_columns(prepared: DataFrame, names: Sequence[str], key: str = "ifa",
                   digits: int | None = 6) -> DataFrame:
    """The scaled vector as plain columns ``z_<name>`` (for inspection and SQL checks)."""
    arr = vector_to_array(F.col(SCALED_COL))
    cols = []
    for i, n in enumerate(names):
        v = arr[i]
        cols.append((F.round(v, digits) if digits is not None else v).alias(f"z_{n}"))
    return prepared.select(key, *cols)


# Partitions of the fitting layout. The labels depend on the layout, so it is
# one parameter that the results carry, not a function of the session or of the
# data's size: raise it (``layout_partitions``) for a larger table.
LAYOUT_PARTITIONS = 32


def fixed_layout(df: DataFrame, key: str = "ifa", partitions: int | None = None) -> DataFrame:
    """Layout that depends only on the data and the parameter: hash by key, sorted by key."""
    return df.repartition(partitions or LAYOUT_PARTITIONS, key).sortWithinPartitions(key)


def silhouette(df: DataFrame, prediction: str = "prediction", features: str = SCALED_COL) -> float:
    """ML-5: mean silhouette, squared Euclidean distance, over all rows."""
    ev = ClusteringEvaluator(predictionCol=prediction, featuresCol=features,
                             metricName="silhouette", distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(df))


@dataclass
class Fit:
    k: int
    model: KMeansModel
    cost: float
    seed: int
    relabel: list[int]          # old label -> stable label


def fit_kmeans(prepared: DataFrame, k: int, seed: int = DEFAULT_SEED, n_init: int = 1,
               max_iter: int = 20, key: str = "ifa", partitions: int | None = None,
               laid_out: bool = False, parallel: int = 4) -> Fit:
    """EXT-2: k-means on a fixed layout; best of ``n_init`` seeds; stable labels.

    Seeds are independent fits and run concurrently (up to ``parallel``).
    A training cost is a sum reduced in task-completion order, so it can
    differ in the last bits between runs; costs within a relative 1e-9 of
    the best count as tied and the lowest seed wins, so the pick does not
    depend on timing.
    """
    data = prepared if laid_out else fixed_layout(prepared.select(key, SCALED_COL), key, partitions)

    def one(s: int) -> tuple[float, int, KMeansModel]:
        model = KMeans(featuresCol=SCALED_COL, k=k, seed=s, maxIter=max_iter).fit(data)
        return float(model.summary.trainingCost), s, model

    seeds = [seed + i for i in range(max(1, n_init))]
    if len(seeds) > 1 and parallel > 1:
        with ThreadPoolExecutor(max_workers=min(parallel, len(seeds))) as pool:
            fits = list(pool.map(one, seeds))
    else:
        fits = [one(s) for s in seeds]
    best_cost = min(c for c, _, _ in fits)
    cost, s, model = min((t for t in fits if t[0] <= best_cost * (1 + 1e-9) + 1e-12),
                         key=lambda t: t[1])
    centres = [tuple(float(x) for x in c) for c in model.clusterCenters()]
    order = sorted(range(len(centres)), key=lambda j: centres[j])
    relabel = [0] * len(centres)
    for new, old in enumerate(order):
        relabel[old] = new
    return Fit(k, model, cost, s, relabel)


def assign(prepared: DataFrame, fit: Fit, out: str = "cluster",
           drop_vectors: bool = True) -> DataFrame:
    """OP-16 / ML-6: cluster label on every full row (key and columns carried)."""
    lut = F.array(*[F.lit(x) for x in fit.relabel])
    scored = fit.model.setPredictionCol("__cluster_raw").transform(prepared)
    scored = scored.withColumn(out, F.element_at(lut, F.col("__cluster_raw") + 1).cast("int")).drop("__cluster_raw")
    if drop_vectors:
        scored = scored.drop(FEATURES_COL, SCALED_COL)
    return scored


def assign_clusters(prepared: DataFrame, k: int = 6, seed: int = DEFAULT_SEED, n_init: int = 1,
                    max_iter: int = 20, key: str = "ifa", partitions: int | None = None,
                    out: str = "cluster") -> DataFrame:
    """OP-16 (ML-3, ML-6): fit and label in one call."""
    fit = fit_kmeans(prepared, k, seed, n_init, max_iter, key, partitions)
    return assign(prepared, fit, out)


def silhouette_sweep(prepared: DataFrame, ks: Sequence[int] = tuple(range(2, 10)),
                     seed: int = DEFAULT_SEED, n_init: int = 1, max_iter: int = 20,
                     key: str = "ifa", partitions: int | None = None,
                     parallel: int = 4) -> DataFrame:
    """OP-15 (ML-4, ML-5): silhouette and training cost for every k.

    The scaled features are laid out and persisted once for all fits (the
    reference recomputes them for each of its eight fits). The fits are
    independent jobs; up to ``parallel`` run at the same time from driver
    threads, which overlaps their per-iteration scheduling. Each fit is
    deterministic on the fixed layout, so the result does not depend on it.
    """
    spark = prepared.sparkSession
    data = fixed_layout(prepared.select(key, SCALED_COL), key, partitions).persist()

    def one(k: int) -> tuple[int, float, float]:
        fit = fit_kmeans(data, k, seed, n_init, max_iter, key, partitions, laid_out=True)
        # sums reduced in task order vary in the last bits; report stable digits
        return (int(k), round(silhouette(fit.model.transform(data)), 12), round(fit.cost, 6),
                int(partitions or LAYOUT_PARTITIONS))

    try:
        data.count()  # materialise the layout once before the fits share it
        if parallel > 1 and len(ks) > 1:
            with ThreadPoolExecutor(max_workers=min(parallel, len(ks))) as pool:
                rows = list(pool.map(one, ks))
        else:
            rows = [one(k) for k in ks]
    finally:
        data.unpersist()
    return spark.createDataFrame(rows, "k int, silhouette double, training_cost double, layout_partitions int")


def nearest(prepared: DataFrame, centres: Sequence[Sequence[float]], out: str = "nearest") -> DataFrame:
    """Index of the nearest centre (squared Euclidean distance, ties to the first) of every row."""
    v = vector_to_array(F.col(SCALED_COL))
    dist = [sum(((v[i] - F.lit(float(x))) * (v[i] - F.lit(float(x))) for i, x in enumerate(c)), F.lit(0.0)) for c in centres]
    return prepared.withColumn(out, (F.array_position(F.array(*dist), F.array_min(F.array(*dist))) - 1).cast("int"))


def lloyd(prepared: DataFrame, centres: Sequence[Sequence[float]], steps: int) -> tuple[DataFrame, list[list[float]]]:
    """ML-3 from given centres: a fixed number of Lloyd steps.

    Returns (centre number, rows and coordinates of the last step; the centres).
    Each step is one aggregate of k rows; a centre without rows stays.
    """
    spark = prepared.sparkSession
    centres = [list(map(float, c)) for c in centres]
    width = len(centres[0])
    rows = []
    for _ in range(steps):
        v = vector_to_array(F.col(SCALED_COL))
        rows = (nearest(prepared.select(SCALED_COL), centres).select("nearest", *[v[i].alias(f"z{i}") for i in range(width)])
                .groupBy("nearest").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"z{i}").alias(f"z{i}") for i in range(width)]).collect())
        for r in rows:
            centres[r["nearest"]] = [float(r[f"z{i}"]) for i in range(width)]
    table = [(int(r["nearest"]), int(r["n"]), *centres[r["nearest"]]) for r in rows]
    schema = "centre int, n long" + "".join(f", z{i} double" for i in range(width))
    return spark.createDataFrame(table, schema), centres


def choose_k(sweep: DataFrame, min_k: int = 4) -> int:
    """ML-7: best silhouette among k >= min_k (the reference chose 6 by hand
    as the best of k >= 4, not the overall arg-max at k = 2)."""
    row = (sweep.where(F.col("k") >= min_k)
           .orderBy(F.col("silhouette").desc(), F.col("k").asc()).first())
    return int(row["k"]) if row else None
