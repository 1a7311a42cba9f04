"""Incremental monthly spend over arriving files (the reference's month loop,
SRC-3 + OP-6 + SNK-1, as a Structured Streaming job).

New usage files land under ``usage_root/month=yyyyMM/`` and device snapshots
under ``devices_root/month=yyyyMM/``, in any order. Both folders are streams,
which only tell which (month, device) keys changed; each micro-batch
recomputes those keys from the complete partitions of their months (a month's
files may arrive over several batches), keeps the other rows of the months'
output, and replaces just those output partitions (dynamic overwrite; a month
that has lost its last row is emptied). A
rerun of a batch after a failure rewrites the same partitions, so the sink is
idempotent; the stream's progress lives in its checkpoint location in the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rfmlens.config import ScoringConfig
from rfmlens.operators.spend import category_usage, latest_prices, monthly_spend
from rfmlens.session import cut_lineage, stage_path
from rfmlens.sources.readers import parquet_files, read_conformed, read_monthly
from rfmlens.sources.sinks import write_parquet


def refresh_keys(spark: SparkSession, changed: DataFrame, usage_root: str, devices_root: str,
                 taxonomy: DataFrame, out_path: str, cfg: ScoringConfig,
                 usage_schema: StructType, device_schema: StructType) -> None:
    """Recompute the spend of the ``changed`` (key, month) pairs (batch job).

    ``changed`` is read several times: pass a staged table.
    """
    keys = [cfg.key, "month"]
    # One row per touched month (as many as the calendar has, not the data).
    months = sorted(r[0] for r in changed.select("month").distinct().collect())
    if not months:
        return
    usage_files, device_files = parquet_files(spark, usage_root), parquet_files(spark, devices_root)
    if not usage_files or not device_files:
        return  # nothing has both sides yet; the other side's files bring the keys again
    usage = read_conformed(spark, usage_root, usage_schema, months, files=usage_files)
    devices = read_conformed(spark, devices_root, device_schema, months, files=device_files)
    priced = latest_prices(devices.join(changed, keys, "left_semi"), cfg.fx_rate, keys)
    streaming = category_usage(usage.join(changed, keys, "left_semi"), taxonomy, cfg.category,
                               cfg.category_col, cfg.spend_excluded, cfg.key)
    spend = monthly_spend(priced, streaming, cfg.key)
    held: set[str] = set()
    if parquet_files(spark, out_path):
        before = read_monthly(spark, out_path, months)
        held = {r[0] for r in before.select("month").distinct().collect()}   # months again
        spend = spend.unionByName(before.join(changed, keys, "left_anti").select(*spend.columns))
    spend = cut_lineage(spend, "spend")
    write_parquet(spend, out_path, mode="overwrite", partition_by=["month"])
    # Dynamic overwrite leaves a month alone that has no rows any more: empty it.
    kept = {r[0] for r in spend.select("month").distinct().collect()}
    for month in sorted(held - kept):
        spend.drop("month").limit(0).coalesce(1).write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/month={month}")


def monthly_spend_stream(spark: SparkSession, usage_root: str, usage_schema: StructType,
                         devices_root: str, taxonomy: DataFrame, out_path: str, cfg: ScoringConfig,
                         checkpoint: str | None = None, available_now: bool = True,
                         max_files_per_trigger: int | None = None,
                         device_schema: StructType | None = None) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what has arrived and stops.

    The schemas must include the ``month`` partition column (string);
    ``device_schema`` is by default the declared one. Both are conformed to:
    files may hold other types (a price as text, double or decimal), and a
    missing column raises. The streams themselves read the key and the month.
    """
    from rfmlens.schemas import DEVICE
    device_schema = device_schema or DEVICE

    def watch(root: str, schema: StructType) -> DataFrame:
        reader = spark.readStream.schema(StructType([schema[cfg.key], schema["month"]]))
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
        return reader.parquet(root).select(cfg.key, "month")

    def on_batch(batch: DataFrame, epoch_id: int) -> None:
        changed = cut_lineage(batch.distinct(), "changed")
        refresh_keys(spark, changed, usage_root, devices_root, taxonomy, out_path, cfg,
                     usage_schema, device_schema)

    source = watch(usage_root, usage_schema).union(watch(devices_root, device_schema))
    writer = (source.writeStream.foreachBatch(on_batch)
              .option("checkpointLocation", checkpoint or stage_path(spark, "spend_stream_ckpt")))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
