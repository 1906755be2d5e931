"""Registered queries: reports, allocation, bounded views, text, ML forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast import columns as C
from revcast.functions import text as TX
from revcast.functions.money import money_sum
from revcast.operators import aggregates as A
from revcast.operators import boosting
from revcast.operators import features as FT
from revcast.operators import ml_forecast as ML
from revcast.operators.allocation import region_country_allocation
from revcast.operators.sampling import explorer_page, price_volume_sample
from revcast.oracle import PROFIT_CTE, half_up, mdec, oracle, series_ctes, total, with_sales
from revcast.plans import forecast as FC
from revcast.plans.report import report
from revcast.queries import KPIS, monthly, query, rounded, sales
from revcast.queries_series import _features_sql, _metrics_sql
from revcast.queries_series import _forecast_sql as _series_forecast_sql
from revcast.session import materialize, work_dir
from revcast.sources import files
from revcast.sources.tables import sales_view

# ---------------------------------------------------------------------------
# Reports
# ---------------------------------------------------------------------------
_SUMMARY_SQL = f"""kk AS (SELECT {total('sales_revenue')} AS total_revenue, {total('total_profit')} AS total_profit,
       CAST(COALESCE(SUM(units_sold), 0) AS BIGINT) AS total_units, COUNT(*) AS n FROM profit),
k2 AS (SELECT total_revenue, total_profit, total_units,
       CASE WHEN n > 0 THEN total_revenue / n ELSE 0.0 END AS avg_order_value,
       CASE WHEN total_revenue > 0 THEN total_profit / total_revenue * 100 ELSE 0.0 END AS margin_pct FROM kk),
summary AS (
  SELECT 'summary' AS section, CAST(1 AS INTEGER) AS rank, 'total_revenue' AS item, total_revenue AS value,
         CAST(NULL AS DOUBLE) AS pct FROM k2
  UNION ALL SELECT 'summary', 2, 'total_profit', total_profit, NULL FROM k2
  UNION ALL SELECT 'summary', 3, 'margin_pct', margin_pct, NULL FROM k2
  UNION ALL SELECT 'summary', 4, 'total_units', CAST(total_units AS DOUBLE), NULL FROM k2
  UNION ALL SELECT 'summary', 5, 'avg_order_value', avg_order_value, NULL FROM k2)"""


def _share_sql(col: str, section: str) -> str:
    return f"""{section}_g AS (SELECT {col} AS item, {mdec('sales_revenue')} AS d FROM profit GROUP BY {col}),
{section}_t AS (SELECT CAST(SUM(d) AS DOUBLE) AS total FROM {section}_g),
{section} AS (SELECT '{section}' AS section, CAST(0 AS INTEGER) AS rank, item, CAST(d AS DOUBLE) AS value,
       CASE WHEN total > 0 THEN CAST(d AS DOUBLE) / total * 100 ELSE 0.0 END AS pct
       FROM {section}_g, {section}_t WHERE item IS NOT NULL)"""


_TOP_SQL = f"""tp_g AS (SELECT product, {total('sales_revenue')} AS value FROM profit WHERE product IS NOT NULL
       GROUP BY product ORDER BY value DESC, product ASC LIMIT 5),
top_products AS (SELECT 'top_products' AS section,
       CAST(ROW_NUMBER() OVER (ORDER BY value DESC, product ASC) AS INTEGER) AS rank,
       product AS item, value, CAST(NULL AS DOUBLE) AS pct FROM tp_g)"""

REPORT_SECTIONS = {
    "executive": ["summary", "region", "category", "top_products"],
    "regional": ["summary", "region"],
    "products": ["summary", "category", "top_products"],
}


def _register_report(report_type: str):
    @query(f"report_{report_type}")
    def q(spark, sf_dir):
        return rounded(report(sales(spark, sf_dir), report_type), {"value": 4, "pct": 6})

    sections = REPORT_SECTIONS[report_type]
    ctes = [PROFIT_CTE, _SUMMARY_SQL]
    if "region" in sections:
        ctes.append(_share_sql("region", "region"))
    if "category" in sections:
        ctes.append(_share_sql("product_category", "category"))
    if "top_products" in sections:
        ctes.append(_TOP_SQL)
    body = "\nUNION ALL ".join(
        f"SELECT section, rank, item, {half_up('value', 4)} AS value, ROUND(pct, 6) AS pct FROM {s}" for s in sections
    )
    oracle(f"report_{report_type}", with_sales(*ctes) + body)


for _t in REPORT_SECTIONS:
    _register_report(_t)


# ---------------------------------------------------------------------------
# Region -> country allocation
# ---------------------------------------------------------------------------
def _allocation_sql(mapping: dict[str, list[str]]) -> str:
    whens = " ".join(
        f"WHEN '{r}' THEN [{', '.join(repr(c) for c in cs)}]" for r, cs in mapping.items()
    )
    return with_sales(
        f"rg AS (SELECT region, {total('sales_revenue')} AS rev FROM sales WHERE region IS NOT NULL GROUP BY region)",
        f"lst AS (SELECT region, rev, CASE region {whens} ELSE ['USA'] END AS countries FROM rg)",
    ) + f"SELECT unnest(countries) AS country, region, {half_up('rev / len(countries)', 4)} AS sales FROM lst"


@query("region_country_allocation")
def q_region_country_allocation(spark, sf_dir):
    return rounded(region_country_allocation(sales(spark, sf_dir)), {"sales": 4})


oracle("region_country_allocation", _allocation_sql(C.DEFAULT_REGION_COUNTRIES))

# A country table keyed by some of the test data's regions (a parameter), so
# the lookup has hits as well as the default.
CUSTOM_COUNTRIES = {"AMERICA": ["USA", "CAN", "BRA"], "EUROPE": ["GBR", "DEU", "FRA"], "ASIA": ["JPN", "CHN", "IND", "KOR"]}


@query("region_country_allocation_table")
def q_region_country_allocation_table(spark, sf_dir):
    rows = [(r, c) for r, cs in CUSTOM_COUNTRIES.items() for c in cs]
    table = spark.createDataFrame(rows, "region string, country string")
    return rounded(region_country_allocation(sales(spark, sf_dir), table), {"sales": 4})


oracle(
    "region_country_allocation_table",
    _allocation_sql({r: sorted(cs) for r, cs in CUSTOM_COUNTRIES.items()}),
)


# ---------------------------------------------------------------------------
# Bounded views
# ---------------------------------------------------------------------------
@query("explorer_page")
def q_explorer_page(spark, sf_dir):
    return explorer_page(sales_view(spark, sf_dir))


oracle(
    "explorer_page",
    with_sales()
    + """SELECT *, (SELECT COUNT(*) FROM sales) AS total_rows FROM sales
ORDER BY date NULLS FIRST, product_category NULLS FIRST, product NULLS FIRST, region NULLS FIRST,
         units_sold NULLS FIRST, price_per_unit NULLS FIRST, discount NULLS FIRST, sales_revenue NULLS FIRST
LIMIT 1000""",
)


@query("price_volume_sample")
def q_price_volume_sample(spark, sf_dir):
    return price_volume_sample(sales(spark, sf_dir))


def _sample_text_sql(column: str) -> str:
    if column == C.DATE:
        return "strftime(date, '%Y-%m-%d %H:%M:%S')"
    if column in (C.CATEGORY, C.PRODUCT, C.REGION):
        return column
    return f"CAST(CAST(FLOOR({column} * 10000 + 0.25) AS BIGINT) AS VARCHAR)"


_SAMPLE_ROW_SQL = " || '|' || ".join(
    ["'42'"] + [f"COALESCE({_sample_text_sql(c)}, '')" for c in (*C.SALES_COLUMNS, C.MARGIN, C.PROFIT)]
)

oracle(
    "price_volume_sample",
    with_sales(PROFIT_CTE)
    + f"""SELECT price_per_unit, units_sold, sales_revenue, product_category, product, region, discount, date
FROM profit ORDER BY md5({_SAMPLE_ROW_SQL}), price_per_unit, units_sold, sales_revenue, product_category, product,
         region, discount, date LIMIT 2000""",
)


# ---------------------------------------------------------------------------
# Text functions over insight responses built from the sales aggregates
# ---------------------------------------------------------------------------
RESPONSE_KINDS = 7


def insight_responses(spark, sf_dir) -> DataFrame:
    """One model-style response per (region, year), with numbers from the sales aggregates.

    The year decides its kind: a JSON fence, no fence, a bare fence with white
    space around it, broken JSON, six items, items without icon or text, and
    short amounts such as $1.5M.
    """
    g = (
        sales(spark, sf_dir)
        .groupBy(C.REGION, F.year(C.DATE).alias(C.YEAR))
        .agg(money_sum(C.REVENUE).alias("d"), F.sum(C.UNITS).alias("u"))
    )
    amount = F.concat(F.lit("$"), F.format_number(F.round("d", 0).cast("bigint"), 0))
    short = F.concat(F.lit("$"), F.floor(F.col("d") / 1000000).cast("string"), F.lit(".5M"))
    units = F.col("u").cast("bigint").cast("string")

    def item(text, icon: str | None = None):
        front = F.lit('{"text": "') if icon is None else F.lit('{"icon": "' + icon + '", "text": "')
        return F.concat(front, text, F.lit('"}'))

    def items(*parts):
        return F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))

    revenue = F.concat(F.lit("Revenue in "), F.col(C.REGION), F.lit(" reached "), amount, F.lit("."))
    two = items(item(revenue, "\U0001F4C8"), item(F.concat(F.lit("Units sold: "), units)), item(F.lit("  "), "⚠"))
    six = items(*(item(F.concat(F.lit(f" No {i}: "), units)) for i in range(1, 7)))
    gaps = items(F.lit('{"icon": "⚠"}'), item(revenue), F.lit('{"text": null, "icon": "x"}'))
    kinds = [
        F.concat(F.lit("```json\n"), two, F.lit("\n```")),
        two,
        F.concat(F.lit("  ```\n"), two, F.lit("```  \n")),
        F.concat(F.lit("```json\nSorry, no insights for "), F.col(C.REGION), F.lit(": "), amount, F.lit(" [{\n```")),
        six,
        gaps,
        F.concat(F.lit("```json "), items(item(F.concat(F.lit("Up "), short, F.lit(" of "), amount), "x")), F.lit("```")),
    ]
    text = F.lit(None).cast("string")
    for k, kind in enumerate(kinds):
        text = F.when(F.col(C.YEAR) % RESPONSE_KINDS == k, kind).otherwise(text)
    return g.select(C.REGION, C.YEAR, text.alias("response"))


_RESPONSES_SQL = f"""rg AS (SELECT region, CAST(year(date) AS INTEGER) AS year, {total('sales_revenue')} AS d,
       SUM(units_sold) AS u FROM profit GROUP BY 1, 2),
rt AS (SELECT region, year, '$' || format('{{:,}}', CAST(ROUND(d, 0) AS BIGINT)) AS amount,
       '$' || CAST(CAST(FLOOR(d / 1000000) AS BIGINT) AS VARCHAR) || '.5M' AS short,
       CAST(CAST(u AS BIGINT) AS VARCHAR) AS units FROM rg),
rv AS (SELECT *, 'Revenue in ' || region || ' reached ' || amount || '.' AS revenue FROM rt),
ri AS (SELECT *, '[{{"icon": "\U0001F4C8", "text": "' || revenue || '"}}, {{"text": "Units sold: ' || units ||
       '"}}, {{"icon": "⚠", "text": "  "}}]' AS two,
       '[' || array_to_string(list_transform(range(1, 7), lambda i: '{{"text": " No ' || CAST(i AS VARCHAR) || ': ' || units || '"}}'), ', ')
       || ']' AS six FROM rv),
resp AS (SELECT region, year, CASE year % {RESPONSE_KINDS}
       WHEN 0 THEN '```json' || chr(10) || two || chr(10) || '```'
       WHEN 1 THEN two
       WHEN 2 THEN '  ```' || chr(10) || two || '```  ' || chr(10)
       WHEN 3 THEN '```json' || chr(10) || 'Sorry, no insights for ' || region || ': ' || amount || ' [{{' || chr(10) || '```'
       WHEN 4 THEN six
       WHEN 5 THEN '[{{"icon": "⚠"}}, {{"text": "' || revenue || '"}}, {{"text": null, "icon": "x"}}]'
       ELSE '```json [{{"icon": "x", "text": "Up ' || short || ' of ' || amount || '"}}]```' END AS response FROM ri),
stripped AS (SELECT region, year, regexp_replace(regexp_replace(regexp_replace(
       regexp_replace(response, '^\\s+|\\s+$', '', 'g'), '^```(?:json)?\\s*', ''), '\\s*```$', ''),
       '^\\s+|\\s+$', '', 'g') AS stripped FROM resp)"""


@query("strip_fences")
def q_strip_fences(spark, sf_dir):
    r = insight_responses(spark, sf_dir)
    return r.select(C.REGION, C.YEAR, TX.strip_fences("response").alias("stripped"))


oracle("strip_fences", with_sales(PROFIT_CTE, _RESPONSES_SQL) + "SELECT * FROM stripped")


@query("mark_currency")
def q_mark_currency(spark, sf_dir):
    r = insight_responses(spark, sf_dir)
    return r.select(C.REGION, C.YEAR, TX.mark_currency(TX.strip_fences("response")).alias("marked"))


oracle(
    "mark_currency",
    with_sales(PROFIT_CTE, _RESPONSES_SQL)
    + """SELECT region, year, regexp_replace(stripped, '\\$[\\d,]+(?:\\.\\d+)?[KMB]?',
       '<b style=''color:#00CC96;''>\\0</b>', 'g') AS marked FROM stripped""",
)


@query("parse_insights")
def q_parse_insights(spark, sf_dir):
    r = insight_responses(spark, sf_dir)
    parsed = r.select(C.REGION, C.YEAR, F.posexplode(TX.parse_insights("response")).alias("pos", "insight"))
    return parsed.select(C.REGION, C.YEAR, "pos", "insight.icon", "insight.text")


oracle(
    "parse_insights",
    with_sales(
        PROFIT_CTE,
        _RESPONSES_SQL,
        """parsed AS (SELECT region, year,
       CASE WHEN json_valid(stripped) THEN from_json(stripped, '[{"icon": "VARCHAR", "text": "VARCHAR"}]') END AS arr
       FROM stripped)""",
        """items AS (SELECT region, year, list_filter(list_transform(arr[1:4], lambda x: {
           'icon': COALESCE(x.icon, '💡'),
           'text': regexp_replace(COALESCE(x.text, ''), '^\\s+|\\s+$', '', 'g')}), lambda x: x.text <> '') AS arr
       FROM parsed)""",
        """ex AS (SELECT region, year, arr, unnest(range(0, len(arr))) AS pos FROM items)""",
    )
    + """SELECT region, year, CAST(pos AS INTEGER) AS pos, arr[pos + 1].icon AS icon,
       regexp_replace(arr[pos + 1].text, '\\$[\\d,]+(?:\\.\\d+)?[KMB]?', '<b style=''color:#00CC96;''>\\0</b>', 'g') AS text
FROM ex""",
)


@query("formatted_summary")
def q_formatted_summary(spark, sf_dir):
    facts = materialize(A.sales_facts(sales(spark, sf_dir), F.year(C.DATE).alias(C.YEAR)))
    yoy_label = A.yoy_growth_from(facts).select("yoy_label").scalar()
    last = facts.agg(F.max("last_date")).scalar()
    return rounded(A.kpi_summary_from(facts), KPIS).select(
        TX.money_text("total_revenue").alias("total_revenue"),
        TX.thousands("total_units").alias("units_sold"),
        TX.money_text("avg_order_value").alias("avg_order_value"),
        TX.percent_text("avg_discount_pct").alias("avg_discount"),
        yoy_label.alias("yoy_label"),
        TX.month_year(last).alias("last_month"),
    )


oracle(
    "formatted_summary",
    with_sales(
        f"""k AS (SELECT {total('sales_revenue')} AS total_revenue, CAST(COALESCE(SUM(units_sold), 0) AS DOUBLE) AS u,
       ROUND(AVG(discount) * 100, 6) AS disc, COUNT(*) AS n, MAX(date) AS last FROM sales)""",
        f"""y AS (SELECT CAST(year(date) AS INTEGER) AS year, {mdec('sales_revenue')} AS d FROM sales
       WHERE date IS NOT NULL GROUP BY 1)""",
        f"""yy AS (SELECT COUNT(*) AS n_years,
       COALESCE(CAST(SUM(CASE WHEN year = (SELECT MAX(year) FROM y) THEN d END) AS DOUBLE), 0.0) AS latest,
       COALESCE(CAST(SUM(CASE WHEN year = (SELECT MAX(year) FROM y) - 1 THEN d END) AS DOUBLE), 0.0) AS prev FROM y)""",
        """yl AS (SELECT CASE WHEN n_years <= 1 THEN 'N/A (Multi-year data required)'
       ELSE printf('%+.1f%% YoY', CASE WHEN prev > 0 THEN (latest - prev) / prev * 100 ELSE 0.0 END) END AS yoy_label
       FROM yy)""",
    )
    + """SELECT '$' || format('{:,.2f}', {round_total}) AS total_revenue,
       format('{:,}', CAST(u AS BIGINT)) AS units_sold,
       '$' || format('{:,.2f}', CASE WHEN n > 0 THEN ROUND(total_revenue / n, 2) ELSE 0.0 END) AS avg_order_value,
       printf('%.1f%%', disc) AS avg_discount,
       (SELECT yoy_label FROM yl) AS yoy_label,
       strftime(last, '%B %Y') AS last_month
FROM k""".replace("{round_total}", half_up("total_revenue")),
)


# ---------------------------------------------------------------------------
# Spark ML forecasting (rows-only checks; see tests for properties)
# ---------------------------------------------------------------------------
ML_KEYS = [C.REGION]


@query("forecast_rf")
def q_forecast_rf(spark, sf_dir):
    res = ML.train_regression_model(monthly(spark, sf_dir, ML_KEYS), 6, "rf", ML_KEYS)
    return res.forecast


@query("forecast_rf_structure")
def q_forecast_rf_structure(spark, sf_dir):
    """What SQL can decide of the forest's forecast: history values, future dates,
    the order of the bounds and the floor at zero."""
    fc = ML.train_regression_model(monthly(spark, sf_dir, ML_KEYS), 6, "rf", ML_KEYS).forecast
    in_order = (F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))
    return fc.select(
        C.REGION,
        C.DS,
        "is_future",
        F.when(~F.col("is_future"), F.round(F.round("yhat", 6), 2)).alias("history"),
        in_order.alias("in_order"),
        (F.col("yhat_lower") >= 0).alias("not_negative"),
    )


oracle(
    "forecast_rf_structure",
    with_sales(*_series_forecast_sql(ML_KEYS, 6))
    + """SELECT region, ds, is_future, CASE WHEN NOT is_future THEN {history} END AS history,
       TRUE AS in_order, TRUE AS not_negative
FROM fc LEFT JOIN series s USING (region, ds)
WHERE region IN (SELECT region FROM series GROUP BY region HAVING COUNT(*) >= 18)""".replace(
        "{history}", half_up("s.sales_revenue")
    ),
)


@query("forecast_rf_metrics")
def q_forecast_rf_metrics(spark, sf_dir):
    return ML.train_regression_model(monthly(spark, sf_dir, ML_KEYS), 6, "rf", ML_KEYS).metrics


@query("forecast_gbt")
def q_forecast_gbt(spark, sf_dir):
    return ML.train_regression_model(monthly(spark, sf_dir, []), 6, "gbt", []).forecast


@query("forecast_rf_weekly")
def q_forecast_rf_weekly(spark, sf_dir):
    """Random forest on the weekly series, 4 weeks ahead (history + 4 rows)."""
    return ML.train_regression_model(monthly(spark, sf_dir, [], freq="W"), 4, "rf", [], freq="W").forecast


LR_DIGITS = {"train_r2": 6, "test_r2": 6, "train_mae": 2, "test_mae": 2, "overfit_gap": 6}


def _backtest_lr(spark, sf_dir, keys):
    return rounded(ML.ml_overfit_report(monthly(spark, sf_dir, keys), keys, models=("lr",)), LR_DIGITS)


@query("backtest_lr")
def q_backtest_lr(spark, sf_dir):
    return _backtest_lr(spark, sf_dir, [])


@query("backtest_lr_series")
def q_backtest_lr_series(spark, sf_dir):
    """A regression for each region and category."""
    return _backtest_lr(spark, sf_dir, LR_KEYS)


LR_KEYS = [C.REGION, C.CATEGORY]
#: The columns of the regression but for the rolling mean, which depends on the lags.
LR_COLUMNS = [*(FT.lag_name(k) for k in C.DEFAULT_LAGS), FT.ROLL_STD, "month", "year"]


def _lr_sql(keys) -> str:
    """Normal equations of each series on scaled columns, solved by elimination."""
    keys = keys or ["one"]
    kc = ", ".join(keys)
    n = len(LR_COLUMNS)
    names = [*LR_COLUMNS, "y"]
    complete = " AND ".join(f"{c} IS NOT NULL" for c in [*LR_COLUMNS, FT.ROLL_MEAN, "discount", "y"])
    stats = ", ".join(f"AVG({c}) FILTER (split = 'train') OVER w AS m{k}, STDDEV_POP({c}) FILTER (split = 'train') OVER w AS s{k}" for k, c in enumerate(names))
    products = ", ".join(
        "[" + ", ".join(f"AVG(z{i} * z{j})" for j in range(n + 1)) + "]" for i in range(n)
    )
    steps = []
    for k in range(1, n + 1):
        steps.append(
            f"""g{k} AS (SELECT {kc}, list_transform(range(1, {n + 1}), lambda i: CASE
       WHEN i = {k} THEN list_transform(m[i], lambda v: v / m[{k}][{k}])
       ELSE list_transform(range(1, {n + 2}), lambda j: m[i][j] - m[i][{k}] * m[{k}][j] / m[{k}][{k}]) END) AS m FROM g{k - 1})"""
        )
    predicted = " + ".join(f"g.m[{k + 1}][{n + 1}] * z{k}" for k in range(n))
    return ",\n".join(
        [
            f"""lr0 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {kc} ORDER BY ds DESC) AS rn, COUNT(*) OVER (PARTITION BY {kc}) AS cnt
FROM (SELECT *, sales_revenue AS y{", 1 AS one" if keys == ["one"] else ""} FROM feats) WHERE {complete})""",
            f"""lr1 AS (SELECT *, CASE WHEN rn <= GREATEST(1, LEAST(6, CAST(FLOOR(cnt * 0.2) AS INTEGER))) THEN 'test' ELSE 'train' END AS split FROM lr0)""",
            f"lr2 AS (SELECT *, {stats} FROM lr1 WINDOW w AS (PARTITION BY {kc}))",
            f"lr3 AS (SELECT *, {', '.join(f'({c} - m{k}) / s{k} AS z{k}' for k, c in enumerate(names))} FROM lr2)",
            f"g0 AS (SELECT {kc}, [{products}] AS m FROM lr3 WHERE split = 'train' GROUP BY {kc})",
            *steps,
            f"lrp AS (SELECT {', '.join(f'lr3.{k}' for k in keys)}, ds, y, split, m{n} + s{n} * ({predicted}) AS yhat FROM lr3 JOIN g{n} g USING ({kc}))",
            _metrics_sql(keys, "lrp", "split"),
            f"""wide AS (SELECT {kc},
       MAX(CASE WHEN split = 'train' THEN r2 END) AS train_r2, MAX(CASE WHEN split = 'test' THEN r2 END) AS test_r2,
       MAX(CASE WHEN split = 'train' THEN mae END) AS train_mae, MAX(CASE WHEN split = 'test' THEN mae END) AS test_mae
FROM mm GROUP BY {kc})""",
        ]
    )


for _name, _keys in {"backtest_lr": [], "backtest_lr_series": LR_KEYS}.items():
    oracle(
        _name,
        with_sales(*series_ctes(_keys), _features_sql(_keys), _lr_sql(_keys))
        + f"""SELECT {"".join(f"{k}, " for k in _keys)}'Linear Regression' AS model, ROUND(train_r2, 6) AS train_r2,
       ROUND(test_r2, 6) AS test_r2, ROUND(train_mae, 2) AS train_mae, ROUND(test_mae, 2) AS test_mae,
       ROUND(train_r2 - test_r2, 6) AS overfit_gap, 'ok' AS status FROM wide""",
    )


# ---------------------------------------------------------------------------
# Boosted trees: the first ones, node by node
# ---------------------------------------------------------------------------
BOOSTED = boosting.Settings(rounds=2)
BOOSTED_COLUMNS = [*(FT.lag_name(k) for k in C.DEFAULT_LAGS), "month"]


@query("boosted_trees")
def q_boosted_trees(spark, sf_dir):
    """Cuts and weights of the first trees on the lags of the monthly series."""
    feats = FT.regression_features(monthly(spark, sf_dir, [])).dropna(how="any")
    feats = rounded(feats, {C.REVENUE: 2} | {FT.lag_name(k): 2 for k in C.DEFAULT_LAGS})
    model = boosting.fit(feats, BOOSTED_COLUMNS, C.REVENUE, boosting.row_ids(F.date_format(C.DS, "yyyy-MM-dd")), BOOSTED)
    nodes = spark.createDataFrame(model.nodes(), "tree int, node int, feature string, cut double, weight double")
    return rounded(nodes, {"weight": 2})


def _hash32_sql(x: str, salt: int) -> str:
    x = f"xor({x}, {salt & 0xFFFFFFFF}::UBIGINT)"
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = f"((xor({x}, {x} >> {shift}) * {factor}::UBIGINT) & 4294967295::UBIGINT)"
    return f"xor({x}, {x} >> 16)"


def _boosted_sql() -> list[str]:
    s = BOOSTED
    n = len(BOOSTED_COLUMNS)
    soft = lambda g: f"(SIGN({g}) * GREATEST(ABS({g}) - {s.l1}, 0.0))"
    part = lambda g, h: f"({soft(g)} * {soft(g)} / ({h} + {s.l2}))"
    weight = lambda g, h: f"(-{soft(g)} / ({h} + {s.l2}))"
    xs = ", ".join(f"{half_up(c) if c != 'month' else f'CAST({c} AS DOUBLE)'} AS x{k}" for k, c in enumerate(BOOSTED_COLUMNS))
    ctes = [
        f"""b0 AS (SELECT CAST('0x' || substr(md5(strftime(ds, '%Y-%m-%d')), 1, 8) AS UBIGINT) AS id, {half_up('sales_revenue')} AS y, {xs}
FROM feats WHERE COLUMNS(*) IS NOT NULL)""",
        "bu AS (SELECT pow(2, CEIL(log2(MAX(ABS(y)))) - 30) AS unit FROM b0)",
        "bb AS (SELECT FLOOR(AVG(y) / ANY_VALUE(unit) + 0.5) * ANY_VALUE(unit) AS base FROM b0, bu)",
        "r0_0 AS (SELECT b0.*, base AS p, unit FROM b0, bb, bu)",
        "cuts AS (" + " UNION ALL ".join(f"(SELECT DISTINCT {k} AS f, x{k} AS cut FROM b0 WHERE x{k} > (SELECT MIN(x{k}) FROM b0))" for k in range(n)) + ")",
    ]
    for t in range(s.rounds):
        drawn = ", ".join(str(int(c)) for c in boosting.drawn_columns(n, s, t))
        ctes.append(
            f"""t{t}_0 AS (SELECT *, 0 AS node, CAST(FLOOR((p - y) / unit + 0.5) AS BIGINT) AS g,
       {_hash32_sql('id', boosting.salt_of(s, t))} < {s.rows} * 4294967296.0 AS taken FROM r0_{t})"""
        )
        for level in range(s.depth):
            x = "CASE f " + " ".join(f"WHEN {k} THEN x{k}" for k in range(n)) + " END"
            ctes.append(
                f"""c{t}_{level} AS (SELECT node, f, cut, SUM(CASE WHEN {x} < cut THEN g ELSE 0 END) * ANY_VALUE(unit) AS gl,
       SUM(CASE WHEN {x} < cut THEN 1 ELSE 0 END) AS hl, SUM(g) * ANY_VALUE(unit) AS gt, COUNT(*) AS ht
FROM t{t}_{level} JOIN cuts ON f IN ({drawn}) WHERE taken AND node >= {2**level - 1} GROUP BY node, f, cut),
s{t}_{level} AS (SELECT *, {part('gl', 'hl')} + {part('(gt - gl)', '(ht - hl)')} - {part('gt', 'ht')} AS gain FROM c{t}_{level}
       WHERE hl >= {s.least_rows} AND ht - hl >= {s.least_rows}),
k{t}_{level} AS (SELECT * FROM s{t}_{level} WHERE gain > 1e-6 QUALIFY ROW_NUMBER() OVER (PARTITION BY node ORDER BY gain DESC, f, cut) = 1),
t{t}_{level + 1} AS (SELECT t.* REPLACE (CASE WHEN k.f IS NULL THEN t.node ELSE 2 * t.node + 1 + CAST({x.replace('CASE f', 'CASE k.f')} >= k.cut AS INTEGER) END AS node)
FROM t{t}_{level} t LEFT JOIN k{t}_{level} k ON t.node = k.node)"""
            )
        splits = " UNION ALL ".join(f"SELECT * FROM k{t}_{level}" for level in range(s.depth))
        ctes.append(
            f"""w{t} AS (SELECT 0 AS node, {weight('gt', 'ht')} AS weight FROM
       (SELECT SUM(g) * ANY_VALUE(unit) AS gt, COUNT(*) AS ht FROM t{t}_0 WHERE taken)
UNION ALL SELECT 2 * node + 1, {weight('gl', 'hl')} FROM ({splits})
UNION ALL SELECT 2 * node + 2, {weight('(gt - gl)', '(ht - hl)')} FROM ({splits})),
n{t} AS (SELECT {t} AS tree, w.node, k.f, k.cut, w.weight FROM w{t} w LEFT JOIN ({splits}) k ON w.node = k.node),
r0_{t + 1} AS (SELECT t.id, t.y, {", ".join(f"t.x{k}" for k in range(n))}, t.p + {s.rate} * w.weight AS p, t.unit
FROM t{t}_{s.depth} t JOIN w{t} w ON t.node = w.node)"""
        )
    return ctes


oracle(
    "boosted_trees",
    with_sales(*series_ctes([]), _features_sql([]), *_boosted_sql())
    + "SELECT CAST(tree AS INTEGER) AS tree, CAST(node AS INTEGER) AS node, CASE f "
    + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(BOOSTED_COLUMNS))
    + " END AS feature, cut, ROUND(weight, 2) AS weight FROM ("
    + " UNION ALL ".join(f"SELECT * FROM n{t}" for t in range(BOOSTED.rounds))
    + ")",
)


@query("overfit_report")
def q_overfit_report(spark, sf_dir):
    from revcast.operators.trend_season import overfit_report as ts_overfit

    series = materialize(monthly(spark, sf_dir, []))
    return ts_overfit(series).withColumn("status", F.lit("ok")).unionByName(ML.ml_overfit_report(series, []))


@query("forecast_csv")
def q_forecast_csv(spark, sf_dir):
    """Trend-season forecast (the dashboard default), future rows exported as CSV and read back."""
    result = FC.forecast(monthly(spark, sf_dir, ML_KEYS), "trend_season", 6, ML_KEYS)
    path = result.write_csv(work_dir(spark, "forecast"))
    schema = "region string, forecasted_month timestamp_ntz, predicted_sales double, lower_bound double, upper_bound double"
    back = files.load_sales(spark, path, fmt="csv", schema=schema, encoding="UTF-8")
    return rounded(back, {"predicted_sales": 2, "lower_bound": 2, "upper_bound": 2})


oracle(
    "forecast_csv",
    with_sales(*_series_forecast_sql(ML_KEYS, 6))
    + """SELECT region, ds AS forecasted_month, ROUND(yhat, 2) AS predicted_sales, ROUND(yhat_lower, 2) AS lower_bound,
       ROUND(yhat_upper, 2) AS upper_bound
FROM fc WHERE is_future AND region IN (SELECT region FROM series GROUP BY region HAVING COUNT(*) >= 15)""",
)


