"""A persistent table of mergeable facts, refreshed by new and changed files only.

A fact is what ``sales_facts`` sums over the rows of one file, month, region, category
and product: sums and counts, from which KPIs, growth, shares and means of any
selection follow.  A refresh lists the source's files, reads those whose path, size
or time is new, and appends their facts; files that are as they were are not read.
Facts of a file that has changed or gone stay in the table, but no longer count, as
only those count that a file in today's list vouches for.

A refresh that dies leaves either all of its facts or none (Spark commits a job's files
together), and running it again is safe: where two loads hold facts of the same
file as it is now, those of one count.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revcast import columns as C
from revcast.functions.periods import period_end
from revcast.operators import aggregates as A

GROUPS = (C.DATE, C.REGION, C.CATEGORY, C.PRODUCT)
#: Paths that one refresh reads in a job.
FILES_A_LOAD = 10_000


def source_files(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """``(path, stamp)`` of the files of a folder; the stamp changes with size and time."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found, each = [], system.listFiles(root, True)
    while each.hasNext():
        file = each.next()
        if not file.getPath().getName().startswith(("_", ".")):
            found.append((file.getPath().toString(), f"{file.getLen()}-{file.getModificationTime()}"))
    return sorted(found)


class FactStore:
    """Facts at ``path`` of the files of ``folder``, read by ``read(paths)`` as canonical sales rows."""

    def __init__(self, spark: SparkSession, path: str, folder: str, read: Callable[[list[str]], DataFrame]):
        self.spark, self.path, self.folder, self.read = spark, path.rstrip("/"), folder, read

    def _stored(self) -> DataFrame | None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/facts")
        there = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/facts") if there else None

    def _listed(self, files: list[tuple[str, str]]) -> DataFrame:
        return self.spark.createDataFrame(files, "file string, stamp string")

    def refresh(self) -> list[str]:
        """Append the facts of files that are new or changed; returns their paths."""
        files, stored = source_files(self.spark, self.folder), self._stored()
        fresh = files
        if stored is not None and files:
            known = stored.select("file", "stamp").distinct()
            fresh = sorted(map(tuple, self._listed(files).join(known, ["file", "stamp"], "left_anti").collect()))
        for k in range(0, len(fresh), FILES_A_LOAD):
            self._load(fresh[k : k + FILES_A_LOAD])
        return [file for file, _ in fresh]

    def _load(self, files: list[tuple[str, str]]) -> None:
        rows = self.read([file for file, _ in files])
        month = F.when(F.col(C.DATE).isNotNull(), period_end(C.DATE, "ME"))
        own = rows.withColumn("file", F.col("_metadata.file_path")).withColumn("__month", month)
        facts = A.sales_facts(own, "file", "__month", *GROUPS[1:]).withColumnRenamed("__month", C.DATE)
        stamped = self._listed(files).withColumn("bare", _bare(F.col("file")))
        # A file without a dated row has a row that says it has been read.
        facts = facts.withColumn("bare", _bare(F.col("file"))).drop("file").withColumn("__facts", F.lit(True))
        facts = stamped.join(facts, "bare", "left").drop("bare").withColumn("load", F.lit(uuid.uuid4().hex))
        facts.write.mode("append").parquet(f"{self.path}/facts")

    def facts(self) -> DataFrame:
        """The facts that count, as ``sales_facts`` by month, region, category and product with ``year``."""
        stored = self._stored()
        if stored is None:
            raise ValueError(f"no facts in {self.path}: refresh first")
        today = self._listed(source_files(self.spark, self.folder))
        chosen = stored.groupBy("file", "stamp").agg(F.min("load").alias("load")).join(today, ["file", "stamp"])
        own = stored.filter("__facts").join(chosen, ["file", "stamp", "load"]).drop("file", "stamp", "load", "__facts")
        return own.withColumn(C.YEAR, F.year(C.DATE)).withColumn(C.DISCOUNT, F.try_divide("__disc", "__discs"))


def _bare(path):
    """A path without the scheme that readers and listings write differently, decoded."""
    return F.try_url_decode(F.regexp_replace(path, r"^[a-z0-9]+:/+", "/"))
