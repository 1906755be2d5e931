"""DuckDB/ANSI SQL text of each registered query (the correctness oracle).

Every statement starts from the same ``sales`` CTE as ``sales_view`` and
reproduces the operator independently in SQL.  Money sums are exact decimals;
both sides round only the columns of the result.
"""

from __future__ import annotations

from revcast.sources.tables import SALES_VIEW_SQL

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


def msum(expr: str) -> str:
    """Exact money sum rounded to cents, as DOUBLE (0.0 when empty)."""
    return f"COALESCE(CAST(CAST(ROUND(SUM(CAST({expr} AS DECIMAL(24,6))), 2) AS DECIMAL(38,2)) AS DOUBLE), 0.0)"


def total(expr: str) -> str:
    """Exact money sum as DOUBLE, not rounded (0.0 when empty)."""
    return f"COALESCE(CAST(SUM(CAST({expr} AS DECIMAL(24,6))) AS DOUBLE), 0.0)"


def half_up(expr: str, digits: int = 2) -> str:
    """A double rounded by its decimal digits, halves up, as Spark rounds (DuckDB's ROUND of a double is binary)."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(30,6)), {digits}) AS DOUBLE)"


def mdec(expr: str) -> str:
    """Exact decimal money sum (for further aggregation)."""
    return f"SUM(CAST({expr} AS DECIMAL(24,6)))"


def cents(expr: str) -> str:
    return f"CAST(CAST(ROUND({expr}, 2) AS DECIMAL(38,2)) AS DOUBLE)"


SALES_CTE = f"sales AS ({SALES_VIEW_SQL})"

# Profit margin lookup with the default table (unknown category -> 0.22).
MARGIN_CASE = """CASE product_category
    WHEN 'Electronics' THEN 0.2134 WHEN 'Accessories' THEN 0.25 WHEN 'Wearables' THEN 0.32
    WHEN 'Home Appliances' THEN 0.18 WHEN 'Others' THEN 0.15 ELSE 0.22 END"""

PROFIT_CTE = f"""profit AS (
  SELECT *, CAST({MARGIN_CASE} AS DOUBLE) AS profit_margin,
         sales_revenue * CAST({MARGIN_CASE} AS DOUBLE) AS total_profit
  FROM sales)"""


def with_sales(*ctes: str) -> str:
    return "WITH " + ",\n".join((SALES_CTE,) + ctes) + "\n"


def _kc(keys) -> str:
    return "".join(f"{k}, " for k in keys)


PERIOD_LABEL_SQL = {
    "ME": "CAST(last_day(date) AS TIMESTAMP)",
    "W": "CAST(CAST(date_trunc('week', date) AS DATE) + 6 AS TIMESTAMP)",
    "D": "CAST(CAST(date AS DATE) AS TIMESTAMP)",
}


def series_ctes(keys=(), freq: str = "ME", source: str = "sales", name: str = "series") -> list[str]:
    """CTEs building the gap-free periodic series ``name`` from ``source``."""
    keys = list(keys)
    kc = _kc(keys)
    where = " AND ".join(["date IS NOT NULL"] + [f"{k} IS NOT NULL" for k in keys])
    group = "GROUP BY " + ", ".join(keys + ["ds"])
    agg = (
        f"{name}_agg AS (SELECT {kc}{PERIOD_LABEL_SQL[freq]} AS ds, {mdec('sales_revenue')} AS d, "
        f"SUM(units_sold) AS u, AVG(discount) AS disc FROM {source} WHERE {where} {group})"
    )
    bgroup = ("GROUP BY " + ", ".join(keys)) if keys else ""
    bnd = f"{name}_bnd AS (SELECT {kc}MIN(ds) AS lo, MAX(ds) AS hi FROM {name}_agg {bgroup})"
    if freq == "ME":
        gen = "generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)"
        lab = "CAST(last_day(g) AS TIMESTAMP)"
    elif freq == "W":
        gen, lab = "generate_series(lo, hi, INTERVAL 7 DAY)", "CAST(g AS TIMESTAMP)"
    else:
        gen, lab = "generate_series(lo, hi, INTERVAL 1 DAY)", "CAST(g AS TIMESTAMP)"
    sp0 = f"{name}_sp0 AS (SELECT {kc}unnest({gen}) AS g FROM {name}_bnd)"
    sp = f"{name}_sp AS (SELECT {kc}{lab} AS ds FROM {name}_sp0)"
    using = ", ".join(keys + ["ds"])
    ser = (
        f"{name} AS (SELECT {''.join(f's.{k}, ' for k in keys)}s.ds, COALESCE(CAST(a.d AS DOUBLE), 0.0) AS sales_revenue, "
        f"CAST(COALESCE(a.u, 0) AS DOUBLE) AS units_sold, a.disc AS discount "
        f"FROM {name}_sp s LEFT JOIN {name}_agg a USING ({using}))"
    )
    return [agg, bnd, sp0, sp, ser]


def partition(keys) -> str:
    return ("PARTITION BY " + ", ".join(keys) + " ") if keys else ""
