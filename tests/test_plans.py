"""Plan-shape checks: no cross joins or Python UDFs, pushdown and pruning."""

from __future__ import annotations

import pytest

from tests.conftest import SMOKE_DIR

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]


def _names():
    import __spark_entry__ as entry

    return sorted(entry.oracle_sql())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", _names())
def test_no_cross_join_or_python_udf(spark, name):
    import __spark_entry__ as entry

    plan = _plan(entry.queries()[name](spark, SMOKE_DIR))
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plans {op}"


def test_date_filter_pushed_into_orders_scan(spark):
    import __spark_entry__ as entry

    df = entry.queries()["filter_date_range"](spark, SMOKE_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_lineitem_scan_is_pruned(spark):
    import __spark_entry__ as entry

    plan = _plan(entry.queries()["kpi_summary"](spark, SMOKE_DIR))
    scan = [line for line in plan.splitlines() if "lineitem.parquet" in line][0]
    assert "l_shipdate" not in scan and "l_comment" not in scan and "l_tax" not in scan


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    import revcast.sources.tables as T

    monkeypatch.setattr(T, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(T.sales_view(spark, SMOKE_DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 3  # orders-customer, lineitem-orders, lineitem-part
    # nation and region are still broadcast (fixed size)
    assert plan.count("BroadcastHashJoin") == 2


ONE_SCAN = [
    "forecast_overlay", "future_only", "forecast_csv", "trend_season_predict", "formatted_summary", "report_executive",
    "contribution", "yoy_growth", "trend_season_forecast", "detrend", "forecast_rf",
]


@pytest.mark.parametrize("name", [n for n in ONE_SCAN if n != "contribution"] + ["category_share", "overfit_report"])
def test_transactions_are_scanned_once(spark, monkeypatch, name):
    """Counts lineitem scans in the final plan and in every plan that is checkpointed on the way."""
    import __spark_entry__ as entry
    from pyspark.sql.classic.dataframe import DataFrame

    seen = []
    real = DataFrame.checkpoint

    def recording(self, *args, **kwargs):
        seen.append(_plan(self))
        return real(self, *args, **kwargs)

    monkeypatch.setattr(DataFrame, "checkpoint", recording)
    df = entry.queries()[name](spark, SMOKE_DIR)
    scans = sum(plan.count("lineitem.parquet") for plan in [*seen, _plan(df)])
    assert scans == 1, f"{name} scans lineitem {scans} times"


def test_explorer_sorts_few_rows(spark):
    """The page's sort sees the first days only, and the rows come out as from a plain sort."""
    from pyspark.sql import functions as F

    from revcast.operators.sampling import explorer_page
    from revcast.sources.tables import sales_view

    df = sales_view(spark, SMOKE_DIR)
    page = explorer_page(df, n=50)
    order = ["date"] + [c for c in df.columns if c != "date"]
    plain = df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(50)
    assert page.drop("total_rows").collect() == plain.collect()
    assert page.first()["total_rows"] == df.count()
    assert "LessThan(o_orderdate" in _plan(page)


def test_lookup_tables_are_broadcast_by_bytes(spark):
    from pyspark.sql import functions as F

    from revcast.operators.profit import broadcast_if_small

    table = spark.createDataFrame([("k" * 100,)] * 10, "k string")
    hinted = lambda df: "rightHint" in df._jdf.queryExecution().toString() or "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(broadcast_if_small(table, F.octet_length("k"), 1000))
    assert not hinted(broadcast_if_small(table, F.octet_length("k"), 999))


def test_a_cluster_session_needs_a_shared_folder(monkeypatch):
    from revcast import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())
