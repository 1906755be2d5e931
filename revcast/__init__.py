"""revcast: sales analytics and forecasting as Spark DataFrame operators.

The library reads raw sales files, maps arbitrary column names onto a
canonical sales schema, derives calendar and profit columns, filters and
profiles the data, computes KPIs and breakdowns, resamples to gap-free
periodic series, builds lag/rolling features and forecasts many series at
once.  Everything is declared with the DataFrame API so Catalyst can push
filters into the scan, prune columns and pick join strategies.

Sub-packages:

* ``sources``   - file and table readers, schema mapping, sinks
* ``functions`` - column-level helpers (coercion, money, periods, text)
* ``operators`` - DataFrame -> DataFrame operators (profit, calendar,
  filters, aggregates, periods, features, forecasting, backtests)
* ``plans``     - composed flows (dashboard, report, forecast dispatch)
"""

from revcast.session import build_session, work_dir  # noqa: F401

__version__ = "0.1.0"
