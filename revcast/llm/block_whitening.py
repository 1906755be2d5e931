"""Embedding whitening on MLlib block matrices.

Entries become whole numbers, ``x = floor(64 c) + 1,000,000``, so that sums and
deviations are exact.  Every distinct vector counts once in what is fitted (the
fit list).  Its centred rows are indexed and cut into a ``BlockMatrix``; transpose
times itself is the scatter matrix, which alone comes to the driver, as large as
the number of dimensions squared, for ``eigh``.  The rows of the table, centred in the same
way, are another ``BlockMatrix``, and its product with the whitening matrix
projects them.

Blocks hold a bounded number of entries.  The scatter product is grouped into
splits of the middle dimension, so that no task sees more than a few blocks and
only partial scatter matrices meet.
"""

from __future__ import annotations

import numpy as np
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcast.llm.common import written
from revcast.llm.vectors import finite_vectors

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries of this size and more are too large for exact sums.
LARGEST = 2.0**30
#: Entries and columns of a block, and row blocks in a split of the scatter product.
BLOCK_ENTRIES, BLOCK_COLUMNS, SPLIT_BLOCKS = 1 << 18, 1024, 8
#: Components whose share of the trace is below this are not told from rounding.
LEAST_SHARE = 1e-12

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def indexed(rows: DataFrame) -> DataFrame:
    """``rows`` (a written table) with ``index``, 0 to their number less one.

    Counts by partition come first, a number for each, then each row's place in its own.
    """
    own = rows.withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id())
    counts = sorted(own.groupBy("__part").count().collect())
    before, offsets = 0, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    # One row for each partition.
    table = rows.sparkSession.createDataFrame(offsets, "__part int, __before long")
    place = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before")
    return own.join(F.broadcast(table), "__part").select(*rows.columns, place.alias("index"))


def centred(x: Column, n: int, sums: list[int]) -> Column:
    """``n * x - S`` by dimension, null where it does not fit a long."""
    return F.zip_with(x, F.lit(sums), lambda v, s: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), v), s))


def block_matrix(rows: DataFrame, n_rows: int, width: int) -> BlockMatrix:
    """``index, row`` (doubles) as a block matrix; rows that are not there are zero."""
    own = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("row").alias("row")), "row")
    columns = min(width, BLOCK_COLUMNS)
    return IndexedRowMatrix(own, n_rows, width).toBlockMatrix(max(1, BLOCK_ENTRIES // columns), columns)


def times(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """The product, its middle dimension in ``splits`` parts that are added up after each is multiplied."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def gram(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times itself, as a local matrix of columns by columns."""
    splits = -(-matrix.numRowBlocks // SPLIT_BLOCKS)
    return times(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def as_blocks(spark, local: np.ndarray) -> BlockMatrix:
    """A local matrix (dimensions by components) as blocks that fit a matrix of vectors on its left."""
    height, width = local.shape
    step = min(height, BLOCK_COLUMNS)
    blocks = []
    for k, first in enumerate(range(0, height, step)):
        part = local[first : first + step]
        blocks.append(((k, 0), Matrices.dense(len(part), width, part.ravel(order="F").tolist())))
    return BlockMatrix(spark.sparkContext.parallelize(blocks, len(blocks)), step, width, height, width)


def row_table(matrix: BlockMatrix) -> DataFrame:
    """``index, row`` (doubles) of a block matrix."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(rows, "vector").select("index", vector_to_array("vector").alias("row"))


def components_of(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, and their unit eigenvectors as columns."""
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    kept = values > LEAST_SHARE * max(np.trace(covariance), 0.0)
    return values[kept], axes[:, kept]


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of each
    row of ``rows`` (``vec_id``, ``embedding``) for its first ``components`` components.

    Rows whose vector is null, empty, of another length than most, or holds entries
    that are null, not finite or too large for an exact ``x`` are left out.  Rows
    with a null id and rows that share an id stay, each with its own result; equal
    vectors are one in the fit list.  A component along which the fit list does not
    vary is left out (one distinct vector has none), so an empty table gives no
    rows.  ``deviation`` is null where it does not fit a long.  Other columns are
    not read.
    """
    spark = rows.sparkSession
    whole = F.transform("vector", lambda c: F.floor(F.lit(SCALE) * c) + F.lit(SHIFT))
    small = F.forall("vector", lambda c: F.abs(c) < F.lit(LARGEST))
    table = written(finite_vectors(rows).filter(small).select("vec_id", whole.alias("x")), "whole-vectors")
    table = written(indexed(table), "indexed")
    # One row for each distinct vector, under the first of its indexes.
    fit = written(table.groupBy("x").agg(F.min("index").alias("index")), "fit-list")
    n, n_rows = fit.count(), table.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    sums = [r["s"] for r in fit.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()]
    width = len(sums)

    exact = centred(F.col("x"), n, sums)
    middle = F.lit([s / n for s in sums])
    row = F.zip_with(F.zip_with("x", middle, lambda v, m: v - m), exact, lambda v, e: F.coalesce(e / F.lit(float(n)), v))
    fitted = block_matrix(fit.select("index", row.alias("row")), n_rows, width)
    covariance = gram(fitted) / n
    values, axes = components_of(covariance, components)
    if not len(values):
        return spark.createDataFrame([], RESULT)
    whitening = as_blocks(spark, axes / np.sqrt(values))
    error = float(np.abs(gram(times(fitted, whitening)) / n - np.eye(len(values))).max())

    projected = row_table(times(block_matrix(table.select("index", row.alias("row")), n_rows, width), whitening))
    deviation = F.aggregate(exact, F.lit(0).cast("long"), lambda s, d: F.try_add(s, F.try_multiply(d, d)))
    own = table.select("index", "vec_id", deviation.alias("deviation")).join(projected, "index")
    explained = F.lit([float(v) for v in values / np.trace(covariance)])
    return own.select("vec_id", "deviation", F.posexplode("row").alias("pos", "whitened")).select(
        "vec_id",
        (F.col("pos") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("pos")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
