"""Least squares from moment matrices, and boosted trees, against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from revcast.operators import boosting as B
from revcast.operators import least_squares as LS


def frame(spark, y, x, series=None):
    n, d = x.shape
    rows = [(k, int(series[k]) if series is not None else 0, float(y[k]), *map(float, x[k])) for k in range(n)]
    return spark.createDataFrame(rows, "i long, s int, y double, " + ", ".join(f"f{k} double" for k in range(d))).repartition(3)


def test_least_squares_per_series(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 4)) * [1e7, 1.0, 1e-3, 1.0] + [5e7, 6.0, 0.0, 2024.0]
    series = np.arange(90) % 3
    y = x @ [0.5, 1e6, 2e9, -3e5] * (1 + series) + rng.normal(size=90) * 1e5
    names = [f"f{k}" for k in range(4)]
    df = frame(spark, y, x, series)
    model = LS.fit(df, names, "y", ["s"])
    got = {r.i: r.prediction for r in LS.predict(df, model, names, ["s"]).collect()}
    for s in range(3):
        own = np.flatnonzero(series == s)
        a = np.column_stack([np.ones(len(own)), x[own]])
        want = a @ np.linalg.lstsq(a, y[own], rcond=None)[0]
        np.testing.assert_allclose([got[i] for i in own], want, rtol=1e-8)
    assert {(r.n, r["rank"]) for r in model.collect()} == {(30, 4)}


def test_singular_designs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    x = np.column_stack([x, x[:, 0] + 2 * x[:, 1], np.full(40, 7.0), x[:, 2] * 0.1 + 0.3])
    y = x[:, 0] - x[:, 2] + rng.normal(size=40) * 0.1
    names = [f"f{k}" for k in range(6)]
    df = frame(spark, y, x)
    model = LS.fit(df, names, "y", ["s"]).first()
    assert model["rank"] == 3 and list(model.coefficients)[3:] == [0.0, 0.0, 0.0]
    a = np.column_stack([np.ones(40), x])
    want = a @ np.linalg.lstsq(a, y, rcond=None)[0]
    got = [model.intercept + float(np.dot(model.coefficients, r)) for r in x]
    np.testing.assert_allclose(got, want, rtol=1e-8, atol=1e-10)
    # Fewer rows than features: the rows of the fit are met exactly.
    few = df.filter("i < 3")
    fit = LS.fit(few, names, "y", ["s"])
    assert all(abs(r.prediction - r.y) < 1e-9 for r in LS.predict(few, fit, names, ["s"]).collect())
    one = LS.fit(df.filter("i = 0"), names, "y", ["s"]).first()
    assert one.n == 1 and one["rank"] == 0 and one.intercept == pytest.approx(y[0])
    assert LS.fit(df.filter("i < 0"), names, "y", ["s"]).count() == 0
    holes = df.withColumn("f0", F.when(F.col("i") > 5, F.col("f0")))
    assert LS.fit(holes, names, "y", ["s"]).first().n == 34
    assert LS.predict(holes, LS.fit(holes, names, "y", ["s"]), names, ["s"]).filter("prediction IS NULL").count() == 6


def boosted_data(n: int = 300, seed: int = 0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 5)), 2)
    return 3 * x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(size=n) * 0.1 + 100, x


NAMES = [f"f{k}" for k in range(5)]


def row_id():
    return B.row_ids(F.col("i").cast("string"))


def test_boosting_fits_and_predicts(spark):
    y, x = boosted_data()
    df = frame(spark, y, x)
    model = B.fit(df, NAMES, "y", row_id())
    assert len(model.trees) == 100
    got = model.transform(df).toPandas()
    assert np.corrcoef(got.y, got.prediction)[0, 1] > 0.99
    bins = B._binned([got[c].to_numpy() for c in NAMES], model.cuts)
    by_hand = np.full(len(got), model.base)
    for tree in model.trees:
        by_hand += model.settings.rate * tree.weight[tree.leaves(bins)]
    np.testing.assert_allclose(got.prediction, by_hand, rtol=1e-12)
    # Unseen values go where their neighbours go.
    far = df.withColumns({c: F.lit(99.0) for c in NAMES})
    assert far.count() and model.transform(far).select("prediction").distinct().count() == 1


def test_boosting_over_tasks_equals_one_task(spark, monkeypatch):
    y, x = boosted_data(200, 3)
    settings = B.Settings(rounds=5, depth=3)
    one = B.fit(frame(spark, y, x), NAMES, "y", row_id(), settings)
    monkeypatch.setattr(B, "BLOCK_ROWS", 10)
    monkeypatch.setattr(B, "WRITE_TREES", 2)
    many = B.fit(frame(spark, y, x).repartition(5), NAMES, "y", row_id(), settings)
    assert one.nodes() == many.nodes()


def test_first_cut_by_brute_force(spark):
    y, x = boosted_data(80, 5)
    settings = B.Settings(rounds=1, depth=1, rows=1.0, columns=1.0, l1=3.0, l2=2.0)
    model = B.fit(frame(spark, y, x), NAMES, "y", row_id(), settings)
    g = model.base - y

    def soft(s):
        return np.sign(s) * max(abs(s) - 3.0, 0.0)

    def part(own):
        return soft(own.sum()) ** 2 / (len(own) + 2.0)

    best = max(
        (part(g[x[:, f] < cut]) + part(g[x[:, f] >= cut]) - part(g), -f, -cut) for f in range(5) for cut in np.unique(x[:, f])[1:]
    )
    (_, _, feature, cut, weight), left, right = model.nodes()
    assert (feature, cut) == (f"f{-best[1]}", -best[2])
    below = x[:, -best[1]] < cut
    assert left[4] == pytest.approx(-soft(g[below].sum()) / (below.sum() + 2.0), rel=1e-6)
    assert right[4] == pytest.approx(-soft(g[~below].sum()) / ((~below).sum() + 2.0), rel=1e-6)


def test_regularisation_and_small_tables(spark):
    y, x = boosted_data(60, 7)
    df = frame(spark, y, x)
    heavy = B.fit(df, NAMES, "y", row_id(), B.Settings(rounds=3, l1=1e9))
    assert {n[4] for n in heavy.nodes()} == {0.0} and len(heavy.nodes()) == 3
    assert B.fit(df.filter("i < 0"), NAMES, "y", row_id()).transform(df).first().prediction == 0.0
    single = B.fit(df.filter("i = 4"), NAMES, "y", row_id(), B.Settings(rounds=2))
    assert single.transform(df).first().prediction == pytest.approx(y[4], rel=1e-6)
    same = B.fit(df.withColumn("y", F.lit(5.0)), NAMES, "y", row_id(), B.Settings(rounds=2))
    assert same.transform(df).first().prediction == pytest.approx(5.0, rel=1e-8)


def test_long_horizon_has_a_plan_of_constant_depth(spark):
    from revcast.operators import ml_forecast as ML

    rng = np.random.default_rng(4)
    rows = [(f"20{20 + k // 12}-{k % 12 + 1:02d}-28", float(1000 + 10 * k + 50 * np.sin(k) + rng.normal()), 0.1) for k in range(40)]
    series = spark.createDataFrame(rows, "ds string, sales_revenue double, discount double").selectExpr("last_day(ds)::timestamp_ntz AS ds", "sales_revenue", "discount")
    depth = {}
    for horizon in (13, 61):
        forecast = ML.train_regression_model(series, horizon=horizon, model="rf").forecast
        plan = forecast._jdf.queryExecution().analyzed().toString()
        depth[horizon] = plan.count("\n")
        future = forecast.filter("is_future").toPandas()
        assert len(future) == horizon and future.ds.is_unique and (future.yhat >= 0).all()
    assert depth[61] == depth[13]
