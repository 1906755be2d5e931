"""Regression forecasting: detrend, lag features, a model, holdout metrics, refit and
a recursive multi-step forecast.

Per series the steps are those of the modelled application:

1. fit a linear trend on the training part (all periods but the holdout) and
   subtract it;
2. build lag 1/2/3/12 and previous-3 rolling mean/std features on the
   detrended series and drop incomplete rows;
3. fit the regressor on all but the last ``max(1, min(6, int(0.2 n)))``
   complete rows, predict the rest, add the trend back and score MAE, RMSE
   and R^2 against the actual values;
4. refit trend and regressor on everything, take the population std of the
   in-sample residuals for the interval;
5. forecast ``h`` steps recursively: each prediction becomes the newest lag.

Scale-out design.  The tree models (Spark ML's forest, :mod:`boosting`) are
fitted over all series at once (pooled), the linear regression for each series
by itself (:mod:`least_squares`);
with series keys the detrended target and its lags are divided by the
series' detrended std so series of different size share one model; with no
keys (one series) nothing is scaled, which is exactly the single-series
setup.  Only series-sized frames (series x periods) are involved.  The
input series is checkpointed to the shared checkpoint folder first, so the
passes of fitting, scoring and forecasting never recompute the sales
aggregation and an executor loss does not replay it; the feature tables are
short derivations of that checkpoint (windows over series-sized data) and
are recomputed where read rather than written again.  The recursive forecast keeps the last
12 detrended values of each series in an ``array<double>``; each step is a
narrow projection (array lookups, ``model.transform``, ``concat``) over one
row per series, so ``h`` steps add no shuffle; after every ``BLOCK_STEPS`` steps
the state is written, so that the plan stays as deep for any horizon.

Series that fail the history guard (fewer than 15 periods or fewer than 6
complete feature rows) are left out of training and forecasting; the result's
``status`` has a row for every series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revcast import columns as C
from revcast.functions.periods import normalise_freq, step_periods
from revcast.operators import boosting, least_squares
from revcast.operators.features import (
    ROLL_MEAN,
    ROLL_STD,
    history_status,
    holdout_size,
    holdout_split,
    lag_name,
    regression_features,
)
from revcast.operators.series import error_metrics, keyed, unkeyed, with_time_index
from revcast.operators.trend_season import overfit_table
from revcast.session import materialize

MODEL_NAMES = {
    "rf": "Random Forest Regressor",
    "gbt": "Gradient-Boosted Trees Regressor",
    "lr": "Linear Regression",
}

DETRENDED_FEATURES = [lag_name(k) for k in C.DEFAULT_LAGS] + [ROLL_MEAN, ROLL_STD, C.MONTH]
RAW_FEATURES = DETRENDED_FEATURES + [C.YEAR]


#: Split candidates of a feature.  Spark's trees cut at quantiles; with this many,
#: series of up to a few hundred periods are cut at every value.
MAX_BINS = 256


def make_forest(max_bins: int = MAX_BINS) -> RandomForestRegressor:
    """The regularised forest (fixed hyper-parameters of the modelled app)."""
    # Node-id caching avoids re-walking trees per level.
    return RandomForestRegressor(
        featuresCol="features", labelCol="label", numTrees=100, maxDepth=8, minInstancesPerNode=2,
        featureSubsetStrategy="all", maxBins=max_bins, cacheNodeIds=True, maxMemoryInMB=512, seed=42,
    )


class Forest:
    """A forest on columns."""

    def __init__(self, train: DataFrame, features: list[str]):
        self.assembler = VectorAssembler(inputCols=features, outputCol="features")
        self.model = make_forest().fit(self.assembler.transform(train))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.assembler.transform(df))


class SeriesRegressions:
    """A linear regression for each series."""

    def __init__(self, train: DataFrame, features: list[str], k: list[str]):
        self.features, self.k = features, k
        self.models = materialize(least_squares.fit(train, features, "label", k))

    def transform(self, df: DataFrame) -> DataFrame:
        return least_squares.predict(df, self.models, self.features, self.k)


def fitted(code: str, train: DataFrame, features: list[str], k: list[str]):
    """A model of ``label``, whose ``transform`` adds ``prediction``."""
    if code == "rf":
        return Forest(_laid_out(train, k), features)
    if code == "gbt":
        row = boosting.row_ids(*(F.col(c).cast("string") for c in k), F.date_format(C.DS, "yyyy-MM-dd HH:mm:ss"))
        return boosting.fit(train, features, "label", row)
    if code == "lr":
        return SeriesRegressions(train, features, k)
    raise ValueError(f"Unknown model {code!r}; use one of {sorted(MODEL_NAMES)}")


def _prepared(series: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    cols = [*keys, C.DS, F.col(value).cast("double").alias("y")]
    cols.append(F.col(C.DISCOUNT) if C.DISCOUNT in series.columns else F.lit(0.0).alias(C.DISCOUNT))
    return series.select(*cols)


def _status(prepared: DataFrame, k: list[str]) -> DataFrame:
    return materialize(history_status(prepared.withColumnRenamed("y", "__v"), k, value="__v"))


#: Training rows in one partition.
LAYOUT_ROWS = 50_000


def _laid_out(rows: DataFrame, k: list[str]) -> DataFrame:
    """Training rows in partitions and an order that only the rows themselves decide.

    Bagging draws by partition and place, so without this a forest would differ
    with the number of shuffle partitions.  The frame is written so that the fit's
    passes read it as it was laid out.
    """
    rows = materialize(rows)
    n = 1 + rows.count() // LAYOUT_ROWS
    return rows.repartition(n, F.xxhash64(*k, C.DS)).sortWithinPartitions(*k, C.DS)


def _trend(df: DataFrame, k: list[str], train_only: bool) -> DataFrame:
    """Add ``t``, ``origin``, trend ``slope``/``intercept`` and ``trend``."""
    df = with_time_index(df, k)
    fit_rows = df
    if train_only:
        fit_rows = holdout_split(df, k).filter(F.col("split") == "train")
    coef = fit_rows.groupBy(*k).agg(
        F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("intercept")
    )
    out = df.join(coef, on=k)
    return out.withColumn("trend", F.col("intercept") + F.col("slope") * F.col("t"))


def _design(prepared: DataFrame, k: list[str], train_only: bool, pooled: bool) -> DataFrame:
    """Detrended, scaled series with lag/rolling features (all rows)."""
    df = _trend(prepared, k, train_only).withColumn("yd", F.col("y") - F.col("trend"))
    if pooled:
        # The spread of the rows that the model may see, like the trend.
        seen = F.col("yd")
        if train_only:
            df = holdout_split(df, k)
            seen = F.when(F.col("split") == "train", F.col("yd"))
        sd = F.stddev_pop(seen).over(Window.partitionBy(*k))
        df = df.withColumn("scale", sd).drop("n_rows", "test_size", "split")
        sd = F.col("scale")
        df = df.withColumn("scale", F.when(sd > 0, sd).otherwise(F.lit(1.0)))
    else:
        df = df.withColumn("scale", F.lit(1.0))
    # Eleven digits: the last ones of the trend hang on the order in which partial sums
    # met, and a tree may choose between equal cuts by them.
    label = F.col("yd") / F.col("scale")
    df = df.withColumn("label", F.when(label.isNotNull(), F.format_string("%.10e", label).cast("double")))
    return regression_features(df, k, value="label")


def _complete(design: DataFrame, k: list[str]) -> DataFrame:
    """Rows with every feature present, with the ML holdout ``split``."""
    need = ["y", C.DISCOUNT, "label"] + DETRENDED_FEATURES + [C.YEAR]
    clean = design.dropna(how="any", subset=need)
    n = F.count(F.lit(1)).over(Window.partitionBy(*k))
    rn = F.row_number().over(Window.partitionBy(*k).orderBy(F.col(C.DS).desc()))
    clean = clean.withColumn("__n", n).withColumn("__rn", rn)
    return clean.withColumn(
        "split", F.when(F.col("__rn") <= holdout_size(F.col("__n")), F.lit("test")).otherwise(F.lit("train"))
    ).drop("__n", "__rn")


class RegressionForecast:
    """Result of ``train_regression_model``: forecast, metrics, model name, and the
    status of every series, also of those left out."""

    def __init__(self, forecast: DataFrame, metrics: DataFrame, model_name: str, status: DataFrame):
        self.forecast = forecast
        self.metrics = metrics
        self.model_name = model_name
        self.status = status


def train_regression_model(
    series: DataFrame,
    horizon: int = 6,
    model: str = "rf",
    keys: Sequence[str] = (),
    value: str = C.REVENUE,
    freq: str = "ME",
) -> RegressionForecast:
    """Backtest, refit and recursively forecast every eligible series.

    Where no series is eligible, forecast and metrics are empty and the status
    says why.
    """
    if int(horizon) < 1:
        raise ValueError("horizon must be at least 1")
    freq = normalise_freq(freq)
    pooled = bool(keys)
    prepared, k = keyed(_prepared(series, keys, value), keys)
    prepared = materialize(prepared)
    status = _status(prepared, k)
    prepared = prepared.join(status.filter(F.col("status") == "ok").select(*k), on=k, how="left_semi")
    status = unkeyed(status)
    if prepared.isEmpty():
        nothing = prepared.select(*k, C.DS, *(F.lit(0.0).alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")))
        scores = error_metrics(prepared.withColumn("yhat", F.col("y")), k).withColumn("model", F.lit(MODEL_NAMES[model]))
        nothing = nothing.withColumn("is_future", F.lit(False))
        return RegressionForecast(unkeyed(nothing), unkeyed(scores), MODEL_NAMES[model], status)

    # 1-3: trend on the training part, model on the training rows, holdout metrics.
    clean = _complete(_design(prepared, k, train_only=True, pooled=pooled), k)
    on_train = fitted(model, clean.filter(F.col("split") == "train"), DETRENDED_FEATURES, k)
    test = on_train.transform(clean.filter(F.col("split") == "test"))
    test = test.withColumn("yhat", F.col("prediction") * F.col("scale") + F.col("trend"))
    metrics = error_metrics(test, k, "y", "yhat").withColumn("model", F.lit(MODEL_NAMES[model]))

    # 4: refit on everything; residual spread in original units.
    design_full = _design(prepared, k, train_only=False, pooled=pooled)
    clean_full = _complete(design_full, k)
    full_model = fitted(model, clean_full, DETRENDED_FEATURES, k)
    resid = (
        full_model.transform(clean_full)
        .withColumn("r", (F.col("label") - F.col("prediction")) * F.col("scale"))
        .groupBy(*k)
        .agg(F.stddev_pop("r").alias("__sd"), F.count(F.lit(1)).alias("__n"))
        .select(*k, F.when(F.col("__n") > 1, F.col("__sd")).otherwise(F.lit(1.0)).alias("resid_std"))
    )

    # 5: recursive forecast from the last 12 detrended values of each series.
    future = recursive_forecast(design_full, full_model, resid, k, int(horizon), freq)
    history = prepared.select(
        *k, C.DS, F.col("y").alias("yhat"), F.col("y").alias("yhat_lower"), F.col("y").alias("yhat_upper"),
        F.lit(False).alias("is_future"),
    )
    forecast = history.unionByName(future.withColumn("is_future", F.lit(True)))
    return RegressionForecast(unkeyed(forecast), unkeyed(metrics), MODEL_NAMES[model], status)


def _last_values(design: DataFrame, k: list[str], n: int = max(C.DEFAULT_LAGS)) -> DataFrame:
    """Per series: the last ``n`` scaled detrended values (oldest first) and
    the trend/scale needed to extend the series."""
    newest_first = Window.partitionBy(*k).orderBy(F.col(C.DS).desc())
    tail = design.withColumn("__rn", F.row_number().over(newest_first)).filter(F.col("__rn") <= n)
    return tail.groupBy(*k).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(C.DS).alias("ds"), F.col("label").alias("v")))),
            lambda s: s["v"],
        ).alias("hist"),
        F.max(C.DS).alias("last_ds"),
        F.first("origin").alias("origin"),
        F.first("slope").alias("slope"),
        F.first("intercept").alias("intercept"),
        F.first("scale").alias("scale"),
    )


def _sample_std3(a: Column, b: Column, c: Column) -> Column:
    m = (a + b + c) / 3.0
    return F.sqrt(((a - m) * (a - m) + (b - m) * (b - m) + (c - m) * (c - m)) / 2.0)


#: Steps of a recursive forecast between two writes of its state.
BLOCK_STEPS = 12


def _in_batches(state: DataFrame, model: boosting.BoostedTrees, horizon: int, freq: str) -> DataFrame:
    """``state`` with all predictions, made in one pass: the steps run over whole batches of series."""
    months = F.array(*(F.month(step_periods("last_ds", step, freq)) for step in range(1, horizon + 1)))
    schema = state.drop("hist").schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            month = np.stack(b["__months"].to_list())
            hist = np.stack(b["hist"].to_list()).astype(np.float64)
            preds = []
            for step in range(horizon):
                last = hist[:, -3:]
                feats = {lag_name(lag): hist[:, -lag] for lag in C.DEFAULT_LAGS}
                feats |= {ROLL_MEAN: last.mean(axis=1), ROLL_STD: last.std(axis=1, ddof=1), C.MONTH: month[:, step].astype(np.float64)}
                preds.append(model.predict([feats[c] for c in model.features]))
                hist = np.column_stack([hist[:, 1:], preds[-1]])
            yield b.drop(columns=["hist", "__months"]).assign(preds=list(np.column_stack(preds)))[schema.names]

    return state.withColumn("__months", months).mapInPandas(run, schema)


def _in_projections(state: DataFrame, model, k: list[str], horizon: int, freq: str) -> DataFrame:
    """``state`` with all predictions, one projection for each step."""
    for step in range(1, horizon + 1):
        ds = step_periods("last_ds", step, freq)
        h = F.col("hist")
        feats = {lag_name(lag): F.try_element_at(h, F.lit(-lag)) for lag in C.DEFAULT_LAGS}
        a, b, c = (F.try_element_at(h, F.lit(-i)) for i in (1, 2, 3))
        feats[ROLL_MEAN] = (a + b + c) / 3.0
        feats[ROLL_STD] = _sample_std3(a, b, c)
        feats[C.MONTH] = F.month(ds)
        stepped = model.transform(state.withColumns(feats))
        state = stepped.select(
            *k, "last_ds", "origin", "slope", "intercept", "scale",
            F.concat(F.slice(h, 2, max(C.DEFAULT_LAGS)), F.array(F.col("prediction"))).alias("hist"),
            F.concat(F.col("preds"), F.array(F.col("prediction"))).alias("preds"),
        )
        if step % BLOCK_STEPS == 0 and step < horizon:
            state = materialize(state)
    return state


def recursive_forecast(
    design_full: DataFrame,
    model,
    resid: DataFrame,
    k: list[str],
    horizon: int,
    freq: str,
) -> DataFrame:
    """``horizon`` future rows per series, each step feeding the next."""
    state = _last_values(design_full, k).withColumn(
        "preds", F.array().cast("array<double>")
    )
    state = _in_batches(state, model, horizon, freq) if isinstance(model, boosting.BoostedTrees) else _in_projections(state, model, k, horizon, freq)
    out = state.select(*k, "last_ds", "origin", "slope", "intercept", "scale", F.posexplode("preds").alias("pos", "p"))
    out = out.withColumn(C.DS, step_periods("last_ds", F.col("pos") + 1, freq))
    t = F.datediff(F.to_date(C.DS), F.to_date("origin"))
    out = out.join(resid, on=k)
    yhat = F.greatest(F.lit(0.0), F.col("p") * F.col("scale") + F.col("intercept") + F.col("slope") * t)
    band = F.lit(C.INTERVAL_Z) * F.col("resid_std")
    return out.select(
        *k,
        C.DS,
        yhat.alias("yhat"),
        F.greatest(F.lit(0.0), yhat - band).alias("yhat_lower"),
        (yhat + band).alias("yhat_upper"),
    )


# ---------------------------------------------------------------------------
# Backtests of all models (overfit report)
# ---------------------------------------------------------------------------
#: Complete feature rows that a backtest needs: one to train on and one to test.
MIN_BACKTEST_ROWS = 2


class Backtests:
    """Backtests of several models on the same series, which is written once.

    A series takes part if it has two complete feature rows; shorter ones keep
    their row in ``status``.  The tables of raw and of detrended features are
    written when the first model asks for them.
    """

    def __init__(self, series: DataFrame, keys: Sequence[str] = (), value: str = C.REVENUE):
        prepared, self.k = keyed(_prepared(series, keys, value), keys)
        self.prepared = materialize(prepared)
        self.pooled = bool(keys)
        self.status = _backtest_status(self.prepared, self.k)
        self._tables: dict[str, DataFrame] = {}

    def _table(self, name: str) -> DataFrame:
        if name not in self._tables:
            ok = self.status.filter(F.col("status") == "ok").select(*self.k)
            rows = self.prepared.join(ok, on=self.k, how="left_semi")
            if name == "raw":
                design = regression_features(rows.withColumn("label", F.col("y")), self.k, value="label")
                design = design.withColumn("scale", F.lit(1.0)).withColumn("trend", F.lit(0.0))
            else:
                design = _design(rows, self.k, train_only=True, pooled=self.pooled)
            self._tables[name] = materialize(_complete(design, self.k))
        return self._tables[name]

    def predictions(self, model: str) -> DataFrame:
        """Per-split predictions on the original scale; ``lr`` on raw lags with the year, trees on detrended ones."""
        features = RAW_FEATURES if model == "lr" else DETRENDED_FEATURES
        clean = self._table("raw" if model == "lr" else "detrended")
        if clean.isEmpty():
            return clean.select(*self.k, C.DS, "y", F.col("y").alias("yhat"), "split")
        pred = fitted(model, clean.filter(F.col("split") == "train"), features, self.k).transform(clean)
        yhat = F.col("prediction") * F.col("scale") + F.col("trend")
        return pred.select(*self.k, C.DS, "y", yhat.alias("yhat"), "split")


def _backtest_status(prepared: DataFrame, k: list[str]) -> DataFrame:
    status = history_status(prepared.withColumnRenamed("y", "__v"), k, value="__v", min_periods=0, min_clean=MIN_BACKTEST_ROWS)
    return materialize(status)


def lag_regression_backtest(series: DataFrame, keys: Sequence[str] = (), value: str = C.REVENUE) -> DataFrame:
    """Linear regression on raw lags, rolling stats, month and year, one for each series:
    per split predictions (no detrending), for the overfit report.

    The rolling mean is the mean of lags 1 to 3, so the design is singular; the
    last of the columns that depend on each other has the coefficient 0."""
    return unkeyed(Backtests(series, keys, value).predictions("lr"))


def detrended_backtest(
    series: DataFrame, model: str, keys: Sequence[str] = (), value: str = C.REVENUE
) -> DataFrame:
    """Tree model on detrended features: per split predictions on the original scale."""
    return unkeyed(Backtests(series, keys, value).predictions(model))


OVERFIT_MODEL_NAMES = {
    "lr": "Linear Regression",
    "rf": "Random Forest (Detrended & Regularized)",
    "gbt": "Gradient-Boosted Trees (Detrended & Regularized)",
}


def ml_overfit_report(
    series: DataFrame, keys: Sequence[str] = (), models: Sequence[str] = ("lr", "rf", "gbt"), value: str = C.REVENUE
) -> DataFrame:
    """Overfit rows (train/test R^2 and MAE, gap, status) of the regression models.

    Every series has a row for each model; the figures are null where ``status``
    is not ``ok``.
    """
    tests = Backtests(series, keys, value)
    k, out = tests.k, None
    for code in models:
        table = overfit_table(tests.predictions(code), k, OVERFIT_MODEL_NAMES[code]).drop("model")
        rows = tests.status.select(*k, "status").join(table, on=k, how="left").withColumn("model", F.lit(OVERFIT_MODEL_NAMES[code]))
        out = rows if out is None else out.unionByName(rows)
    return unkeyed(out.select(*k, "model", "train_r2", "test_r2", "train_mae", "test_mae", "overfit_gap", "status"))
