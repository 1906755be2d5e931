"""File sources and sinks, the driver entry points and the SQL oracle sweep."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from revcast.sources import files
from revcast.sources.tables import TABLES
from tests.conftest import SMOKE_DIR


def test_format_dispatch():
    assert files.detect_format("a/b.CSV") == "csv"
    assert files.detect_format("x.parquet") == "parquet"
    with pytest.raises(ValueError, match="Excel"):
        files.detect_format("sales.xlsx")
    with pytest.raises(ValueError, match="Unsupported"):
        files.detect_format("sales.txt")


def test_latin1_csv_falls_back(spark, tmp_dir):
    path = os.path.join(tmp_dir, "latin1.csv")
    with open(path, "wb") as fh:
        fh.write("Date,Region,Sales\n2024-01-01,Montréal,10.5\n".encode("latin-1"))
    df = files.load_sales(spark, path)
    assert df.first()["Region"] == "Montréal"
    utf8 = files.load_sales(spark, path, encoding="UTF-8").first()["Region"]
    assert "\ufffd" in utf8


def test_csv_roundtrip_and_forecast_export(spark, tmp_dir):
    df = spark.createDataFrame([(1.5, "x")], "value double, name string")
    out = files.write_csv(df, os.path.join(tmp_dir, "out"))
    back = files.load_sales(spark, out, fmt="csv", schema="value double, name string")
    assert back.collect() == df.collect()
    fc = spark.createDataFrame([("2024-01-31", 1.0, 0.5, 1.5)], "ds string, yhat double, yhat_lower double, yhat_upper double")
    assert files.forecast_export(fc).columns == ["forecasted_month", "predicted_sales", "lower_bound", "upper_bound"]
    assert files.forecast_file_name("Random Forest Regressor") == "sales_forecast_random_forest_regressor.csv"


def test_entry_smoke(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["product_category", "sales_revenue", "units_sold"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _norm(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        row = []
        for v in rec:
            if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
                row.append(None)
            elif isinstance(v, pd.Timestamp) or hasattr(v, "isoformat"):
                row.append(pd.Timestamp(v).isoformat())
            elif hasattr(v, "item"):
                row.append(v.item())
            else:
                row.append(v)
        out.append(tuple(row))
    return cols, sorted(out, key=lambda r: tuple("" if x is None else str(x) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE_DIR}/{t}.parquet')")
    return con


def _oracle_names():
    import __spark_entry__ as entry

    return sorted(entry.oracle_sql())


@pytest.mark.parametrize("name", _oracle_names())
def test_query_matches_sql_oracle(spark, duck, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, SMOKE_DIR).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    gc, gr = _norm(got)
    wc, wr = _norm(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr
