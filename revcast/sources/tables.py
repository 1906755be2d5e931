"""Readers for the parquet test tables and the canonical ``sales`` view.

``sales_view`` turns the star schema into one row per line item in the
canonical sales schema::

    date             orders.o_orderdate          (timestamp_ntz)
    product_category part.p_type
    product          part.p_name
    region           region.r_name via orders -> customer -> nation
    units_sold       lineitem.l_quantity
    price_per_unit   l_extendedprice / l_quantity
    discount         lineitem.l_discount
    sales_revenue    l_extendedprice * (1 - l_discount)

Join plan.  nation (25 rows) and region (5 rows) have a fixed size, so they
are always broadcast.  customer, orders and part grow with the data: each is
broadcast only if the bytes of its files, looked up each time, are under
``BROADCAST_BYTES``; above the limit no hint is given and Spark shuffles both
sides on the join key (sort-merge join, AQE splitting skewed partitions, which
deployments must leave on).  The join order keeps lineitem as the streamed
side: orders are joined to customer regions first (an orders-sized join),
then lineitem to orders on the order key and to part on the part key.
Spark's basic statistics multiply input sizes for joins, which would
otherwise make the pruned lineitem look like the smaller side and get it
broadcast.  Only the needed columns are read, and filters on ``date`` are
pushed through the joins into the orders scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revcast import columns as C

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# A broadcast side is held in memory by every executor: 32 MB of parquet, of
# which only a few narrow key/label columns are read, stay well under ~100 MB.
BROADCAST_BYTES = 32 << 20


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Read a parquet table, selecting ``cols`` (pruned in the scan)."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*cols) if cols else df


def table_bytes(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Bytes of a table's files as they are now (a listing, no job)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, name))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def broadcast_if_small(
    df: DataFrame, spark: SparkSession, sf_dir: str, name: str, limit: int | None = None
) -> DataFrame:
    """Broadcast hint for a side derived from table ``name`` (at most as many
    rows as the table) when the table's files have at most ``limit`` bytes
    (default ``BROADCAST_BYTES``), looked up each time."""
    limit = BROADCAST_BYTES if limit is None else limit
    return F.broadcast(df) if table_bytes(spark, sf_dir, name) <= limit else df


def customer_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, r_name): customer joined to its region name."""
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "r_name"
    )
    customer = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    cust = customer.join(F.broadcast(geo), customer.c_nationkey == geo.n_nationkey).select("c_custkey", "r_name")
    return broadcast_if_small(cust, spark, sf_dir, "customer")


def sales_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical sales rows built from lineitem/orders/part/customer/nation/region."""
    return sales_view_of(spark, sf_dir, read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders"))


def sales_view_of(spark: SparkSession, sf_dir: str, lineitem: DataFrame, orders: DataFrame, in_place: bool = False) -> DataFrame:
    """``sales_view`` from given lineitem and orders; ``in_place`` if both are bucketed by the
    order key, so that they meet first, where they lie."""
    lineitem = lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    orders = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    cust = customer_regions(spark, sf_dir)
    part = broadcast_if_small(part, spark, sf_dir, "part")
    if in_place:
        met = lineitem.join(orders.hint("merge"), lineitem.l_orderkey == orders.o_orderkey)
        met = met.join(cust, met.o_custkey == cust.c_custkey)
    else:
        order_region = orders.join(cust, orders.o_custkey == cust.c_custkey).select("o_orderkey", "o_orderdate", "r_name")
        order_region = broadcast_if_small(order_region, spark, sf_dir, "orders")
        met = lineitem.join(order_region, lineitem.l_orderkey == order_region.o_orderkey)
    joined = met.join(part, met.l_partkey == part.p_partkey)
    return joined.select(
        F.col("o_orderdate").cast("timestamp_ntz").alias(C.DATE),
        F.col("p_type").alias(C.CATEGORY),
        F.col("p_name").alias(C.PRODUCT),
        F.col("r_name").alias(C.REGION),
        F.col("l_quantity").alias(C.UNITS),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias(C.PRICE),
        F.col("l_discount").alias(C.DISCOUNT),
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias(C.REVENUE),
    )


# DuckDB/ANSI text of the same view, used as the CTE prefix of every oracle.
SALES_VIEW_SQL = """
SELECT CAST(o_orderdate AS TIMESTAMP) AS date, p_type AS product_category, p_name AS product,
       r_name AS region, l_quantity AS units_sold, l_extendedprice / NULLIF(l_quantity, 0) AS price_per_unit,
       l_discount AS discount, l_extendedprice * (1.0 - l_discount) AS sales_revenue
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
"""
