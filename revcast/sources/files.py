"""File sources and sinks for sales data.

``load_sales`` picks the reader from the file suffix (csv, parquet, json;
Excel has no built-in Spark reader and is refused with ``ValueError`` like
any unknown suffix).  CSV is read as UTF-8, but files whose bytes are not are
read as ISO-8859-1 (which decodes every byte), matching the latin-1 fallback
of the modelled application.  A folder's files are judged one by one.  Pass
``encoding`` to skip the check, which is one scan of the files' bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revcast.functions.coerce import qcol

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json"}

# Display names of the forecast export.
FORECAST_EXPORT_NAMES = {
    "ds": "forecasted_month",
    "yhat": "predicted_sales",
    "yhat_lower": "lower_bound",
    "yhat_upper": "upper_bound",
}


def detect_format(path: str) -> str:
    low = path.lower().rstrip("/")
    for suffix, fmt in FORMATS.items():
        if low.endswith(suffix):
            return fmt
    if low.endswith((".xls", ".xlsx")):
        raise ValueError("Excel files are not supported by the Spark readers; export the sheet to CSV or parquet.")
    raise ValueError("Unsupported file format. Please provide a CSV, parquet or JSON file.")


def _read_csv(spark: SparkSession, path: str | list[str], schema, encoding: str) -> DataFrame:
    reader = spark.read.option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def files_not_utf8(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The files under ``path`` whose bytes are UTF-8, and those whose are not.

    Lines are read as bytes and each file is judged by its own; a U+FFFD that a
    file really holds is valid UTF-8 and changes nothing.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8")).collect()
    by_kind = {kind: sorted(r["file"] for r in rows if r["utf8"] == kind) for kind in (True, False)}
    return by_kind[True], by_kind[False]


def _read_mixed(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV files of ``path``, each read as UTF-8 if its bytes are, else as ISO-8859-1."""
    utf8, latin = files_not_utf8(spark, path)
    if not latin:
        return _read_csv(spark, path, schema, "UTF-8")
    first = _read_csv(spark, utf8 or latin, schema, "UTF-8" if utf8 else "ISO-8859-1")
    if not utf8:
        return first
    # Types may be inferred from either kind of file; where they differ, text holds both.
    second = _read_csv(spark, latin, schema, "ISO-8859-1")
    same = {f.name: f.dataType for f in second.schema.fields}
    as_text = [f.name for f in first.schema.fields if f.name in same and same[f.name] != f.dataType]

    def aligned(df: DataFrame) -> DataFrame:
        return df.withColumns({n: qcol(n).cast("string") for n in as_text}) if as_text else df

    return aligned(first).unionByName(aligned(second), allowMissingColumns=True)


def load_sales(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    encoding: str | None = None,
) -> DataFrame:
    """Read a sales file (or folder of part files) into a DataFrame."""
    fmt = fmt or detect_format(path)
    if fmt == "csv":
        if encoding:
            return _read_csv(spark, path, schema, encoding)
        return _read_mixed(spark, path, schema)
    if fmt not in ("parquet", "json"):
        raise ValueError(f"Unsupported format {fmt!r}")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8", mode: str = "overwrite") -> str:
    """Write a frame as header CSV part files (no index column)."""
    df.write.mode(mode).option("header", True).option("encoding", encoding).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> str:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def forecast_export(forecast: DataFrame) -> DataFrame:
    """Forecast rows with export column names."""
    return forecast.withColumnsRenamed({k: v for k, v in FORECAST_EXPORT_NAMES.items() if k in forecast.columns})


def write_forecast_csv(forecast: DataFrame, path: str) -> str:
    return write_csv(forecast_export(forecast), path)


def forecast_file_name(model_name: str) -> str:
    return f"sales_forecast_{model_name.lower().replace(' ', '_')}.csv"
