"""Exact dedup by a persistent digest index, bucketed and sorted by hash.

Texts are equal when identical after lower-casing A-Z; the key is the SHA-256
of that text.  The index is a catalog table ``(digest, keep_id, keep_row,
load, group_size)`` bucketed and sorted by ``digest``.  A load

1. writes the digests of its rows (not their texts) to the shared folder,
2. groups them by digest, combining before the shuffle, so that a text with
   any number of copies costs one row per task,
3. finds the digests that other loads did not bring by a sort-merge anti-join,
   in which the bucketed index is not shuffled (the first load meets an empty
   index), and appends those that the index lacks,
4. joins the verdict of each group back to the rows.  Digests of more than one
   row in ``HEAVY_SHARE`` (so at most that many digests) are joined by a
   broadcast, so that no task gets all copies of a text; the others by merge.

Everything runs on Spark's own expressions.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revcast.llm.common import fresh_path, under_plain_names, whole_text, written

#: About this many digests per bucket of a new index.
DIGESTS_PER_BUCKET = 2_000_000
#: A digest is heavy if more than one row in this many has it; no more digests than this can be.
HEAVY_SHARE = 2_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def text_digest(text: str | Column = "text") -> Column:
    """SHA-256 (32 bytes) of the text in UTF-8 after lower-casing A-Z; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(whole_text(text)).cast("binary"), 256))


class DigestIndex:
    """A table of the digests seen so far.

    ``table`` names a catalog table.  It is made, empty, by the first load with
    ``buckets`` buckets (by default one per two million digests of that load)
    and keeps its bucketing afterwards.  Its files lie in ``location``, by
    default in the warehouse, which on a cluster must be a folder that all
    executors share.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None, location: str | None = None):
        self.spark, self.table, self.buckets, self.location = spark, table, buckets, location

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def create(self, n_digests: int) -> None:
        """The empty table, if there is none; ``n_digests`` are expected in the first load."""
        if self.exists():
            found = self.spark.sql(f"DESCRIBE EXTENDED {self.table}").filter("col_name = 'Num Buckets'")
            self.buckets = int(found.first()["data_type"])
            return
        self.buckets = self.buckets or max(8, -(-n_digests // DIGESTS_PER_BUCKET))
        where = f"LOCATION '{self.location}'" if self.location else ""
        self.spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, keep_row BIGINT, load STRING, group_size BIGINT)"
            f" USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS {where}"
        )

    def drop(self) -> None:
        """Forget the index.  Verdicts of earlier loads do not read it and stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def unseen(self, groups: DataFrame, load: str | None = None) -> DataFrame:
        """The rows of ``groups`` whose digest no load but ``load`` brought."""
        others = self.read().filter(F.col("load") != load) if load else self.read()
        return groups.join(others.select("digest").hint("merge"), "digest", "left_anti")

    def append(self, rows: DataFrame) -> None:
        (
            rows.repartition(self.buckets, "digest")
            .write.format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .saveAsTable(self.table)
        )

    def load(self, docs: DataFrame, load: str | None = None) -> DataFrame:
        """Deduplicate ``docs`` (columns ``doc_id``, ``text``) within itself and
        against the index, append the new digests and return a verdict per row.

        ``load`` is the caller's name of the load.  A load that is run again
        under its name, say after the job that used its verdicts was lost, gives
        the same verdicts and appends only what is not there yet; without a name
        every load is a new one.

        Result: ``doc_id, keep_id, group_size, kept, digest``, one row for each
        row of ``docs``.  Of equal texts the row with the largest ``doc_id``
        stays; a null id is smaller than any other; of rows that are equal in
        both, exactly one stays.  A text that another load brought is not
        kept and names that load's row.  ``group_size`` counts the equal rows of
        the load that brought the text.  A null text is the empty text.  An
        empty table gives no rows.  Other columns are not read.
        """
        load = load or uuid.uuid4().hex
        rows = written(
            docs.select(
                F.monotonically_increasing_id().alias("row"),
                F.col("doc_id").cast("long").alias("doc_id"),
                text_digest("text").alias("digest"),
            ),
            "digests",
        )
        best = F.max(F.struct("doc_id", "row"))
        groups = written(
            rows.groupBy("digest")
            .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
            .select(
                "digest",
                F.col("best.doc_id").alias("keep_id"),
                F.col("best.row").alias("keep_row"),
                F.lit(load).alias("load"),
                "group_size",
            ),
            "digest-groups",
        )
        size = groups.agg(F.count(F.lit(1)).alias("digests"), F.coalesce(F.sum("group_size"), F.lit(0)).alias("rows")).first()
        self.create(size["digests"])
        fresh = written(self.unseen(groups, load), "digest-fresh")
        known = self.read().filter(F.col("load") != load).hint("merge").join(groups.select("digest"), "digest", "left_semi")
        verdicts = written(fresh.unionByName(known), "digest-verdicts")
        self.append(self.unseen(fresh))
        verdict = "digest", "keep_id", "keep_row", "load", "group_size"
        heavy = groups.filter(F.col("group_size") > size["rows"] / HEAVY_SHARE).select("digest")
        heavy_verdicts = verdicts.join(F.broadcast(heavy), "digest").select(*verdict)
        told = rows.join(F.broadcast(heavy_verdicts), "digest").unionByName(
            rows.join(F.broadcast(heavy), "digest", "left_anti").join(verdicts.hint("merge"), "digest")
        )
        return told.select(
            "doc_id",
            "keep_id",
            "group_size",
            ((F.col("load") == load) & (F.col("row") == F.col("keep_row"))).alias("kept"),
            "digest",
        )


def new_index(spark: SparkSession) -> DigestIndex:
    """An index for the loads of one session: under an unused name, with its files in the shared folder."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", location=fresh_path(spark, "digest-index"))


def keep_unique(docs: DataFrame, index: DigestIndex, load: str | None = None) -> DataFrame:
    """The rows of ``docs`` that ``index.load`` keeps, with all their columns.

    Only the ids of dropped rows are joined back, with digests where other rows
    of the id stay.  Where the input repeats a whole (id, text) pair, one row of it stays.  A null text is an empty
    one; rows without id count as the smallest id; an empty table gives no rows.
    """
    return under_plain_names(docs, lambda own: _keep_unique(own, index, load))


def _keep_unique(docs: DataFrame, index: DigestIndex, load: str | None) -> DataFrame:
    verdicts = index.load(docs, load)
    own = docs.withColumn("__own", F.col("doc_id").cast("long"))
    # In a file of known size: while the ids are few Spark broadcasts them and shuffles no text.
    fates = written(
        verdicts.groupBy("doc_id")
        .agg(F.count_if(~F.col("kept")).alias("n_lost"), F.max("kept").alias("__some"))
        .filter("n_lost > 0")
        .select(F.col("doc_id").alias("__id"), "__some"),
        "ids-lost",
    )
    rest = own.join(fates.filter("NOT __some"), F.col("__own").eqNullSafe(F.col("__id")), "left_anti")
    part = fates.filter("__some").select("__id")
    if part.isEmpty():
        return rest.drop("__own")
    lost = written(
        verdicts.join(part, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
        .groupBy("doc_id", "digest")
        .agg(F.count_if(~F.col("kept")).alias("n_lost"), F.count_if("kept").alias("n_kept"))
        .filter("n_lost > 0")
        .select(F.col("doc_id").alias("__id"), F.col("digest").alias("__lost"), (F.col("n_kept") > 0).alias("__repeat")),
        "digest-lost",
    )
    marked = rest.withColumn("__digest", text_digest("text"))
    same = F.col("__digest").eqNullSafe(F.col("__lost")) & F.col("__own").eqNullSafe(F.col("__id"))
    if lost.filter("__repeat").isEmpty():
        return marked.join(lost, same, "left_anti").drop("__digest", "__own")
    joined = marked.join(lost, same, "left")
    single = joined.filter("__repeat").dropDuplicates(["__id", "__lost"])
    return joined.filter("__lost IS NULL").unionByName(single).select(*docs.columns)
