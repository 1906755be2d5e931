"""Helpers that several operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.  Python's
#: ``bytes.split()`` cuts at exactly these characters.
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without that setting gets a private folder; on a
    cluster the setting is required, because executors could not read a folder
    of the driver's machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="revcast-llm-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut, and
    readable by any executor after another is lost.

    Nothing refers to the job's shuffle files any more when it ends.  Spark
    deletes them once the driver collects its garbage, which is asked for here
    so that they do not pile up over a query of many jobs.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` gave, when what was made of them is written too."""
    for table in tables:
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def whole_text(col: str | Column = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def under_plain_names(docs: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``keep(docs)``, whose other columns than ``doc_id`` and ``text`` bear names that no operator uses meanwhile."""
    own = docs.toDF(*(name if name in ("doc_id", "text") else f"c{k}" for k, name in enumerate(docs.columns)))
    return keep(own).toDF(*docs.columns)
