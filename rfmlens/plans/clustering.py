"""Entry B: wide per-device table -> features -> silhouette sweep -> k-means labels.

The fit is the layout-independent one (``operators.kmeans``): the same rows and seed give the same labels on any cluster, at any
parallelism. The reference re-attaches predictions to the input by a generated row id
(``monotonically_increasing_id`` on two independently planned frames), which only lines up while both keep identical partitioning and order;
here a row is labelled by its own features, so nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from rfmlens.config import ClusteringConfig
from rfmlens.operators import kmeans
from rfmlens.operators.cluster import choose_k, complete_features, renamed_features


def cluster_table(wide: DataFrame, cfg: ClusteringConfig = ClusteringConfig(),
                  sweep: bool = False, min_k: int = 4) -> tuple[DataFrame, DataFrame | None]:
    """Returns (clustered table, sweep or None). With ``sweep`` the k is the
    best silhouette of k >= ``min_k`` (ML-7), else ``cfg.k``.

    ``cfg.n_init`` seeds are tried one after another; the lowest cost wins, of equal costs the lower seed.
    """
    clean = complete_features(wide, cfg.features, cfg.key)
    points = kmeans.points_of(clean, cfg.features, cfg.key)
    sweep_df = None
    k = cfg.k
    if sweep:
        sweep_df = kmeans.sweep(points, cfg.ks, cfg.seed, cfg.max_iter)
        k = choose_k(sweep_df, min_k) or cfg.k
    fits = [f for s in range(max(1, cfg.n_init)) if (f := kmeans.fit(points, k, cfg.seed + s, cfg.max_iter))]
    if not fits:
        raise ValueError("no row has all features")
    best = min(fits, key=lambda f: f.cost)
    return renamed_features(kmeans.label_rows(clean, points, best)), sweep_df
