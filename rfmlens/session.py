"""Session helpers: local sessions for tests/bench and the shared stage folder.

On a cluster the session comes from the caller; nothing here overrides its
settings. The only thing we may set is a checkpoint folder, and only when the
session names none (local tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "rfmlens") -> SparkSession:
    """A local session configured like the test/bench harness."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for checkpoints and stage tables.

    Read from the session (``spark.checkpoint.dir`` or an already set
    checkpoint directory). Only a local session that has neither (tests) gets
    a private folder; on a cluster that raises, because each executor would
    write to its own disk.
    """
    try:
        configured = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # noqa: BLE001
        configured = None
    if configured:
        return configured.rstrip("/")
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 -- remote (Connect) sessions have no context
        sc = None
    if sc is not None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
        if configured:
            return configured.rstrip("/")
        current = sc.getCheckpointDir()
        if current:
            # getCheckpointDir returns <dir>/<uuid>; stage tables go next to it.
            return os.path.dirname(current.rstrip("/"))
    master = sc.master if sc is not None else "remote"
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="rfmlens-ckpt-")
    sc.setCheckpointDir(own)
    return own


#: Stage folders given out since the last ``clear_stages``.
_STAGES: list[str] = []


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh location under the shared folder for one stage table."""
    path = f"{shared_dir(spark)}/stages/{name}-{uuid.uuid4().hex[:12]}"
    _STAGES.append(path)
    return path


def clear_stages(spark: SparkSession) -> int:
    """Remove the stage tables that this process has made, through the file system that Spark uses for them; their number.

    For the end of a job, when its results are written: frames that still read a stage table can't be used
    afterwards.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while _STAGES:
        path = jvm.org.apache.hadoop.fs.Path(_STAGES.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed


def cut_lineage(df: DataFrame, name: str = "stage", parquet: bool = True) -> DataFrame:
    """Cut the lineage of a frame that several later jobs read.

    Default: a Parquet stage table in the shared folder (columnar, so a later
    job that needs one column reads one column; survives executor loss).
    ``parquet=False`` uses a reliable RDD checkpoint in the same folder.
    Never a local checkpoint: those die with their executor.
    """
    spark = df.sparkSession
    if not parquet:
        shared_dir(spark)
        return df.checkpoint(eager=True)
    path = stage_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
