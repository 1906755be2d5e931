"""Ordinary least squares, one model per series, from moment matrices.

One aggregate per series gives the moment matrix of its features and target: the
sums of all products, which combine before the shuffle and are as large as the
number of features squared, however long the series.  Columns are centred and
scaled to unit spread first, so that levels such as the year do not drown the
rest.  The matrix is solved where it lies, by sweeping one feature after the other
in array expressions, so any number of series is one narrow projection.

Singular designs have a defined result: a feature that the ones before it explain
(or that does not vary) is not swept and gets the coefficient 0.  On the rows of
the fit this changes no prediction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A feature whose variance that the others leave is below this share is explained by them.
TOLERANCE = 1e-9


def _swept(matrix: Column, size: int, tolerance: float) -> Column:
    """The symmetric moment matrix (``size`` features, then the target) after sweeping its
    features in turn; the target's column then holds the coefficients."""

    def cell(m: Column, i: Column, j: Column) -> Column:
        return F.get(F.get(m, i), j)

    def step(m: Column, k: Column) -> Column:
        pivot = cell(m, k, k)
        rows = F.transform(
            m,
            lambda row, i: F.transform(
                row,
                lambda v, j: F.when((i == k) & (j == k), -1.0 / pivot)
                .when(i == k, v / pivot)
                .when(j == k, v / pivot)
                .otherwise(v - F.get(row, k) * cell(m, k, j) / pivot),
            ),
        )
        return F.when(pivot > tolerance, rows).otherwise(m)

    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix, step)


def fit(rows: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], tolerance: float = TOLERANCE) -> DataFrame:
    """``keys, n, rank, intercept, coefficients`` of each series in ``rows``.

    ``coefficients`` has the order of ``features``.  Rows with a null feature or
    target are left out; a series without any other has no row.  A single row, or a
    constant target, gives the mean as intercept and coefficients of 0.
    """
    names = list(features)
    size = len(names)
    own = rows.select(*keys, *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate([*names, target]))).dropna()
    whole = Window.partitionBy(*keys)
    columns = [f"x{k}" for k in range(size + 1)]
    own = own.withColumns({f"m{c}": F.avg(c).over(whole) for c in columns} | {f"s{c}": F.stddev_pop(c).over(whole) for c in columns})
    # A spread that is only the rounding of the mean is none.
    flat = {c: F.col(f"s{c}") <= F.abs(F.col(f"m{c}")) * 1e-13 for c in columns}
    scaled = {c: F.when(flat[c], 0.0).otherwise((F.col(c) - F.col(f"m{c}")) / F.col(f"s{c}")) for c in columns}
    own = own.withColumns({f"z{c}": z for c, z in scaled.items()})
    products = [F.avg(F.col(f"z{a}") * F.col(f"z{b}")).alias(f"p{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    moments = own.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *products, *(F.first(f"m{c}").alias(f"m{c}") for c in columns), *(F.first(f"s{c}").alias(f"s{c}") for c in columns)
    )
    matrix = F.array(*(F.array(*(F.col(f"p{min(i, j)}_{max(i, j)}") for j in range(size + 1))) for i in range(size + 1)))
    swept = moments.withColumn("swept", _swept(matrix, size, tolerance))
    # A swept diagonal is -1 or below, as no scaled feature varies by more than 1.
    used = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.get(F.get(F.col("swept"), k), k) < -0.5)
    scales = F.array(*(F.col(f"s{c}") for c in columns[:-1]))
    means = F.array(*(F.col(f"m{c}") for c in columns[:-1]))
    swept = swept.withColumn("used", used).withColumn("scales", scales).withColumn("means", means)
    coefficient = F.transform(
        "used", lambda u, k: F.when(u, F.get(F.get(F.col("swept"), k), F.lit(size)) * F.col(f"s{columns[-1]}") / F.get(F.col("scales"), k)).otherwise(0.0)
    )
    out = swept.withColumn("coefficients", coefficient)
    explained = F.aggregate(F.zip_with("coefficients", "means", lambda b, m: b * m), F.lit(0.0), lambda s, v: s + v)
    rank = F.size(F.filter("used", lambda u: u))
    return out.select(*keys, "n", rank.alias("rank"), (F.col(f"m{columns[-1]}") - explained).alias("intercept"), "coefficients")


def predict(rows: DataFrame, model: DataFrame, features: Sequence[str], keys: Sequence[str], name: str = "prediction") -> DataFrame:
    """``rows`` with the prediction of their series' model; null where it has none or a feature is null."""
    values = F.array(*(F.col(c).cast("double") for c in features))
    joined = rows.join(model.select(*keys, F.col("intercept").alias("__b"), F.col("coefficients").alias("__c")), list(keys), "left")
    total = F.aggregate(F.zip_with("__c", values, lambda b, x: b * x), F.col("__b"), lambda s, v: s + v)
    return joined.withColumn(name, total).drop("__b", "__c")
