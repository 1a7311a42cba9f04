"""rfmlens: customer-value scoring, segmentation and audience export on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function (usable with
``df.transform``); only the functions in ``rfmlens.sources.sinks`` write.

Sub-packages
------------
sources    readers (month-partitioned Parquet, typed CSV, lineage) and sinks
functions  column expressions (date anchors, bands, safe casts and ratios)
operators  usage, taxonomy, spend, RFM, global percent rank, clustering,
           profiles, audience lists
plans      end-to-end jobs (scoring, clustering, profiling) and the query
           registry used by ``__spark_entry__``
streaming  incremental monthly scoring input over a file stream
"""

from rfmlens.config import ScoringConfig, ClusteringConfig

__all__ = ["ScoringConfig", "ClusteringConfig"]
