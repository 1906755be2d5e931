"""Sales stored for reading: a written table by month, and bucketed sources.

``write_layout`` joins the star once and writes the canonical sales rows under one
folder for each month.  What reads it afterwards joins nothing: a date range picks
folders, and columns are pruned in the scan.  Rows are dealt by month with
``REBALANCE``, so that a month with a third of all rows is split over several files
and small ones share a task.

``bucket_sources`` stores lineitem and orders bucketed and sorted by the order key,
so that every later rebuild of the join reads both in place: neither is shuffled.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revcast import columns as C
from revcast.session import work_dir
from revcast.sources.tables import read_table, sales_view, sales_view_of, table_bytes

MONTH_FOLDER = "sale_month"
UNDATED = "none"
#: About so many bytes of lineitem in a bucket.  One task sorts and joins a bucket, so this bounds its memory.
BUCKET_BYTES = 16 << 20


def write_layout(sales: DataFrame, path: str) -> None:
    """Write canonical sales rows under ``path``, one folder for each month; undated rows have their own."""
    month = F.coalesce(F.date_format(C.DATE, "yyyy-MM"), F.lit(UNDATED))
    sales.withColumn(MONTH_FOLDER, month).hint("rebalance", MONTH_FOLDER).write.partitionBy(MONTH_FOLDER).parquet(path)


def read_layout(spark: SparkSession, path: str, start: str | dt.date | None = None, end: str | dt.date | None = None) -> DataFrame:
    """The rows of a layout, of the days from ``start`` to ``end`` if given; other months' folders are not read."""
    schema = "date timestamp_ntz, product_category string, product string, region string, units_sold double, " \
        f"price_per_unit double, discount double, sales_revenue double, {MONTH_FOLDER} string"
    rows = spark.read.schema(schema).parquet(path)
    if start is not None:
        first = dt.date.fromisoformat(str(start)[:10])
        rows = rows.filter((F.col(MONTH_FOLDER) >= first.strftime("%Y-%m")) & (F.col(C.DATE) >= F.lit(first).cast("timestamp_ntz")))
    if end is not None:
        last = dt.date.fromisoformat(str(end)[:10])
        after = last + dt.timedelta(days=1)
        rows = rows.filter((F.col(MONTH_FOLDER) <= last.strftime("%Y-%m")) & (F.col(C.DATE) < F.lit(after).cast("timestamp_ntz")))
    return rows.drop(MONTH_FOLDER)


class BucketedSources:
    """Names of the bucketed tables of a star."""

    def __init__(self, lineitem: str, orders: str):
        self.lineitem, self.orders = lineitem, orders

    def drop(self, spark: SparkSession) -> None:
        for name in (self.lineitem, self.orders):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def bucket_sources(spark: SparkSession, sf_dir: str, buckets: int | None = None) -> BucketedSources:
    """Store the columns of lineitem and orders that sales need, bucketed and sorted by the order key.

    The files lie in the shared folder; the catalog holds where.  One shuffle each,
    by bucket, so that a bucket is one sorted file.
    """
    buckets = buckets or max(8, -(-table_bytes(spark, sf_dir, "lineitem") // BUCKET_BYTES))
    folder = work_dir(spark, "buckets")
    names = {}
    for table, key, columns in (
        ("lineitem", "l_orderkey", ["l_partkey", "l_quantity", "l_extendedprice", "l_discount"]),
        ("orders", "o_orderkey", ["o_custkey", "o_orderdate"]),
    ):
        names[table] = f"{table}_{uuid.uuid4().hex}"
        rows = read_table(spark, sf_dir, table, key, *columns).repartition(buckets, key)
        rows.write.bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/{table}").format("parquet").saveAsTable(names[table])
    return BucketedSources(names["lineitem"], names["orders"])


def sales_view_bucketed(spark: SparkSession, sf_dir: str, sources: BucketedSources) -> DataFrame:
    """``sales_view`` whose largest join meets bucket by bucket, without an exchange of lineitem or orders."""
    return sales_view_of(spark, sf_dir, spark.table(sources.lineitem), spark.table(sources.orders), in_place=True)


def stored_sales(spark: SparkSession, sf_dir: str) -> str:
    """The star's sales as a layout in the shared folder; the path."""
    path = work_dir(spark, "sales-layout") + "/sales"
    write_layout(sales_view(spark, sf_dir), path)
    return path
