"""What the operators on embeddings share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector holds entries, none of them null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def finite_vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id`` (long) and ``vector`` (doubles) of the rows whose vector is finite.

    Vectors of different lengths have neither a product nor a covariance: those of
    the length that most rows have (the longer one of two as frequent) stay.
    """
    own = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    own = own.filter(finite(F.col("vector")))
    lengths = own.groupBy(F.size("vector").alias("d")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    return own.filter(F.size("vector") == (most["d"] if most else 0))
