"""Spark session helpers.

The library never creates its own cluster settings beyond what a job needs:
on a cluster the session already exists and carries ``spark.checkpoint.dir``
(a shared, fault-tolerant folder); only in tests or local runs do we pick one.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "paperlens",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.ui.enabled", "false")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only on a single machine one is made if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # one machine, as in tests: a private scratch folder is shared enough
        conf_dir = tempfile.mkdtemp(prefix="paperlens-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder, for tables that several jobs read by
    columns: smaller than a checkpoint, and as safe from lost executors."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that nothing refers to any more: its cleaner acts when
    the driver collects garbage. Twice, since the first time what Python held is only let go."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss) for tables reused by several passes."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
