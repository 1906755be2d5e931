"""Session helpers.

``build_session`` is for tests, benchmarks and scripts; library code never
creates a session, it works on whatever session the caller passes in.

``work_dir`` gives a folder for intermediate tables (checkpoints, CSV
round-trips).  On a cluster it must be shared storage, so it is derived from
``spark.checkpoint.dir``, and a cluster session without that setting is
refused; only a local session gets a private scratch folder.  What is written
there goes when the session's JVM ends.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(
    master: str = "local[*]",
    shuffle_partitions: int = 8,
    app_name: str = "revcast",
    extra: dict | None = None,
) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a private one only for a local session that has none."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if not current:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if sc.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="revcast-ckpt-")
        sc.setCheckpointDir(configured)
        current = sc.getCheckpointDir() or configured
    # Spark makes a folder of its own below the configured one for each application.
    delete_at_end(spark, current)
    return current


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the JVM delete ``path`` when it ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def materialize(df):
    """Write a small, reused intermediate to the shared checkpoint folder.

    For series- or group-sized frames that several branches of a plan read:
    they are computed once, the lineage back to the transaction scan is cut,
    and a lost executor re-reads the checkpoint instead of rescanning.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh, uniquely named folder under the checkpoint directory."""
    base = checkpoint_dir(spark)
    path = base.rstrip("/") + f"/revcast-{name}-{uuid.uuid4().hex[:12]}"
    if path.startswith("file:"):
        os.makedirs(path[len("file:"):], exist_ok=True)
    return path


def write_table(df, name: str):
    """``df`` as Parquet under the checkpoint directory: computed once, pruned and filtered by
    whoever reads it.  Columns are stored by place, so any name will do."""
    path = work_dir(df.sparkSession, name) + "/table"
    stored = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    stored.write.parquet(path)
    return df.sparkSession.read.schema(stored.schema).parquet(path).toDF(*df.columns)
