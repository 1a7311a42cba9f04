"""Co-located joins for tables that are written once and joined every month (JN-1, OP-1).

A table that is stored in buckets of its key, sorted by it, joins another one of the same buckets without an exchange or a sort on either
side: each task merges one bucket of both. A bucket holds all rows of its keys, though, so a key with more than
1/``HOT_SHARE`` of the rows is stored apart, in an ordinary table. There are fewer than ``HOT_SHARE`` such keys, so their
rows of the other side are broadcast and joined map-side.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rfmlens.operators.skew import HOT_SHARE
from rfmlens.session import stage_path


@dataclass(frozen=True)
class Stored:
    """name: table in buckets of ``key``; hot_path: rows of its hot keys; location: the folder of both."""

    name: str
    key: str
    buckets: int
    location: str

    @property
    def hot_path(self) -> str:
        return f"{self.location}/hot"

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows, in no order."""
        return spark.table(self.name).unionByName(spark.read.parquet(self.hot_path))


def store_by_key(df: DataFrame, key: str, buckets: int, name: str = "stored", location: str | None = None,
                 hot_share: int = HOT_SHARE) -> Stored:
    """Write ``df`` in ``buckets`` buckets of ``key``. One keys-only aggregate finds the hot keys; ``df`` is read twice."""
    spark = df.sparkSession
    out = Stored(f"{name}_{uuid.uuid4().hex[:12]}", key, buckets, location or stage_path(spark, name))
    keys = df.select(F.col(f"`{key}`").alias("__hot_key")).groupBy("__hot_key").agg(F.count(F.lit(1)).alias("n"))
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = keys.where((F.col("n") * hot_share > F.lit(total)) & F.col("__hot_key").isNotNull()).select("__hot_key")
    is_hot = F.col(f"`{key}`") == F.col("__hot_key")
    df.join(F.broadcast(hot), is_hot, "left_semi").write.parquet(out.hot_path)   # fewer than hot_share keys
    hot = spark.read.parquet(out.hot_path).select(F.col(f"`{key}`").alias("__hot_key")).distinct()
    cold = df.join(F.broadcast(hot), is_hot, "left_anti")
    # one task a bucket writes one file of it
    cold.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{out.location}/cold").saveAsTable(out.name)
    return out


def join_stored(spark: SparkSession, big: Stored, small: Stored) -> DataFrame:
    """Inner join on the key of two stored tables of the same buckets; ``small`` has one row for each key."""
    if (big.key, big.buckets) != (small.key, small.buckets):
        raise ValueError("both tables must have the same key and number of buckets")
    hot = spark.read.parquet(big.hot_path)
    hot_keys = hot.select(big.key).distinct()
    few = small.rows(spark).join(F.broadcast(hot_keys), big.key, "left_semi")
    cold = spark.table(big.name).join(spark.table(small.name), big.key)
    # a key that is hot in ``small`` alone has one row there and few in ``big``
    apart = spark.table(big.name).join(F.broadcast(spark.read.parquet(small.hot_path)), big.key)
    return cold.unionByName(apart).unionByName(hot.join(F.broadcast(few), big.key))
