from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import evaluate, forecast, models

D0 = dt.date(2016, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def history(spark, values, k="s"):
    return spark.createDataFrame([(k, day(i), None if v is None else float(v)) for i, v in values], "k string, date date, v double")


def test_seasonal_naive_on_a_sparse_series(spark):
    # Days 0..13 without day 8: its weekday falls back to day 1.
    h = history(spark, [(i, i) for i in range(14) if i != 8])
    got = {(r.ds - D0).days: r.yhat for r in forecast.seasonal_naive(h, ["k"], "date", "v", 10).collect()}
    assert got == {14: 7.0, 15: 1.0, 16: 9.0, 17: 10.0, 18: 11.0, 19: 12.0, 20: 13.0, 21: 7.0, 22: 1.0, 23: 9.0}


def test_seasonal_naive_covers_the_horizon_whatever_is_missing(spark):
    h = history(spark, [(0, 1), (3, 4), (5, None)]).unionByName(history(spark, [(2, None)], "empty"))
    got = forecast.seasonal_naive(h, ["k"], "date", "v", 8).orderBy("ds").collect()
    assert [r.ds for r in got] == [day(6 + i) for i in range(8)]
    assert [r.yhat for r in got] == [2.5, 1.0, 2.5, 2.5, 4.0, 2.5, 2.5, 2.5]


def test_regression_leaves_out_missing_values(spark):
    values = [(i, 5.0 + i if i != 9 else None) for i in range(20)]
    got = forecast.seasonal_regression(history(spark, values), ["k"], "date", "v", 2, ridge=1e-6).orderBy("ds").collect()
    assert {r.status for r in got} == {"ok"} and got[0].yhat == pytest.approx(25.0, abs=0.5)


def test_seasonal_naive_scores_about_one_on_train(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(20, 4, 400)
    h = history(spark, list(enumerate(values)))
    fit = evaluate.seasonal_differences(h, ["k"], "date", "v", 7).dropna()
    fit = fit.select("k", F.col("v").alias("y"), (F.col("v") - F.col("diff")).alias("yhat"), F.lit("naive").alias("model"))
    got = evaluate.all_metrics(fit, evaluate.seasonal_scale(h, ["k"], "date", "v", 7), ["k"]).first()
    assert got.rmsse == pytest.approx(1.0, abs=1e-6)


def test_constant_and_quantile_forecasts(spark):
    h = history(spark, [(0, 1), (1, 2), (2, 6)])
    got = forecast.constant_forecast(h, ["k"], "date", F.avg("v"), 2).orderBy("ds").collect()
    assert [(r.ds, r.yhat) for r in got] == [(day(3), 3.0), (day(4), 3.0)]
    q = forecast.quantile_forecast(h, ["k"], "date", "v", 1, (0.25, 0.5)).orderBy("quantile").collect()
    assert [(r.quantile, r.yhat) for r in q] == [(0.25, 1.5), (0.5, 2.0)]


def test_future_frame(spark):
    h = spark.createDataFrame([("s", day(0), 3.0), ("s", day(1), 4.0), ("s", day(2), None)], "k string, date date, price double")
    got = forecast.future_frame(h, ["k"], "date", 2, "price", ["flag"], 9).orderBy("ds").collect()
    assert [(r.ds, r.price, r.flag, r.event_name_encoded) for r in got] == [(day(3), 4.0, 0, 9), (day(4), 4.0, 0, 9)]
    assert got[0].day_of_week == 2  # 2016-01-04 is a Monday


def test_regression_follows_trend_and_week(spark):
    n = 400
    truth = lambda i: 50 + 0.05 * i + 5 * np.sin(2 * np.pi * i / 7)
    h = history(spark, [(i, truth(i)) for i in range(n)])
    got = forecast.seasonal_regression(h, ["k"], "date", "v", 14, ridge=1e-6).orderBy("ds").collect()
    assert [r.ds for r in got] == [day(n + i) for i in range(14)] and {r.status for r in got} == {"ok"}
    np.testing.assert_allclose([r.yhat for r in got], [truth(n + i) for i in range(14)], atol=0.5)
    assert all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in got)


def test_failures_keep_the_job_going(spark):
    h = history(spark, [(i, i) for i in range(30)]).unionByName(history(spark, [(0, 1)], "short"))
    h = h.unionByName(history(spark, [(0, 1), (1, None)], "gap"))
    out = forecast.seasonal_regression(h, ["k"], "date", "v", 3)
    rows = {k: [r for r in out.collect() if r.k == k] for k in ("s", "short", "gap")}
    assert {len(r) for r in rows.values()} == {3} and rows["s"][0].status == "ok"
    assert all(r.yhat == 0.0 and r.status.startswith("failed") for r in rows["short"] + rows["gap"])
    assert {r.status: r.n_series for r in forecast.failed_series(out, ["k"]).collect()}["ok"] == 1


def test_forecasts_are_clipped(spark):
    h = history(spark, [(i, 100 - 5 * i) for i in range(20)])
    got = forecast.seasonal_regression(h, ["k"], "date", "v", 28).collect()
    assert all(r.yhat >= 0 and r.yhat_lower >= 0 for r in got)


def test_decomposition_adds_up(spark):
    rng = np.random.default_rng(2)
    h = history(spark, [(i, 10 + 3 * (i % 7 == 5) + rng.normal()) for i in range(70)])
    got = forecast.decompose(h, ["k"], "date", "v").orderBy("date").collect()
    assert all(r.v == pytest.approx(r.trend + r.seasonal + r.residual) for r in got)
    assert sum(r.seasonal for r in got[:7]) == pytest.approx(0, abs=1e-9)
    assert max(range(7), key=lambda i: got[i].seasonal) == 5


def test_decomposition_keeps_the_clock_over_a_gap(spark):
    values = [(i, 10.0 + 4 * (i % 4 == 1)) for i in range(80) if i not in (22, 23, 41)]
    got = forecast.decompose(history(spark, values), ["k"], "date", "v", period=4).collect()
    inner = [r for r in got if 4 <= (r.date - D0).days < 16]
    assert all(r.trend == pytest.approx(11.0) and r.residual == pytest.approx(0, abs=0.3) for r in inner)
    top = {(r.date - D0).days % 4 for r in got if r.seasonal > 1}
    assert top == {1}


def test_scoring_loses_no_row(spark):
    df = spark.createDataFrame([(float(i), float(2 * i), i > 40) for i in range(60)], "a double, y double, newest boolean")
    rows = df.select("a").unionByName(spark.createDataFrame([(None,)], "a double"))
    trees = models.fit_trees(df, ["a"], "y", F.col("newest"), rounds=5, depth=2)
    line = models.fit_linear(df, ["a"], "y")
    assert models.predict(trees, rows).count() == 61
    got = models.predict(line, rows).filter("a IS NULL").collect()
    assert len(got) == 1 and got[0].yhat == pytest.approx(0, abs=1e-6)


def test_trees_predict_and_rank(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 10, (600, 2))
    rows = [(float(a), float(b), float(3 * a), bool(i > 500)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, target double, newest boolean")
    model = models.fit_trees(df, ["a", "b"], "target", F.col("newest"), rounds=10, depth=3)
    top = models.importances(model, ["a", "b"]).first()
    assert top.feature == "a" and top.importance > 0.9
    scored = models.predict(model, df)
    assert "features" not in scored.columns and scored.agg(F.min("yhat")).first()[0] >= 0


def test_multiplicative_seasons_scale_with_the_trend(spark):
    n = 600
    truth = lambda i: (20 + 0.1 * i) * (1 + 0.4 * np.sin(2 * np.pi * i / 7))
    h = history(spark, [(i, truth(i)) for i in range(n)])
    errors = {}
    for kind in (False, True):
        model = forecast.SeasonalModel(multiplicative=kind, changes=10, ridge=1e-3, change_ridge=0.1)
        got = forecast.seasonal_regression(h, ["k"], "date", "v", 14, model=model).orderBy("ds").collect()
        errors[kind] = max(abs(r.yhat - truth(n + i)) / truth(n + i) for i, r in enumerate(got))
        assert all(0 <= r.yhat_lower <= r.yhat <= r.yhat_upper for r in got)
    assert errors[True] < 0.06 < errors[False]


@pytest.mark.parametrize("multiplicative", [False, True])
def test_fits_have_the_sum_of_the_observations(spark, multiplicative):
    rng = np.random.default_rng(3)
    values = [(i, None if i % 17 == 0 else float(v)) for i, v in enumerate(rng.poisson(3, 300))]
    h = history(spark, values).unionByName(history(spark, [(0, 1.0)], "short")).unionByName(history(spark, [(0, 0.0), (1, 0.0)], "zero"))
    rows = forecast.seasonal_fitted(h, ["k"], "date", "v", model=forecast.SeasonalModel(multiplicative=multiplicative, changes=5)).collect()
    assert sum(r.fitted for r in rows if r.k == "s" and r.v is not None) == pytest.approx(sum(v for _, v in values if v is not None))
    assert all(r.fitted is None for r in rows if r.v is None or r.k == "short")
    assert [r.fitted for r in rows if r.k == "zero"] == pytest.approx([0, 0], abs=1e-9)


def test_a_planted_change_of_slope_is_found():
    days = np.arange(1500.0)
    y = 1000 + 0.5 * days - 1.5 * np.maximum(0, days - 600) + np.random.default_rng(1).normal(0, 1, 1500)
    none = np.zeros((1500, 0))
    fit = forecast.SeasonalModel(changes=20, change_ridge=1e-3, ridge=1e-3).fit(days, y, none)
    at, size = min(fit.slopes(), key=lambda s: s[1])
    assert abs(at - 600) <= 60 and sum(s for a, s in fit.slopes() if 450 < a < 750) == pytest.approx(-1.5, abs=0.25)
    assert fit.spread < 0.2 * forecast.SeasonalModel().fit(days, y, none).spread


def test_an_outlier_moves_no_neighbour_of_a_robust_decomposition(spark):
    rng = np.random.default_rng(5)
    clean = [(i, float(20 + 0.1 * i + 4 * (i % 7 == 2) + rng.normal())) for i in range(140)]
    wild = [(i, v + 500 * (i == 70)) for i, v in clean]
    parts = {}
    for name, values in (("clean", clean), ("wild", wild)):
        h = history(spark, values)
        parts[name] = [{(r.date - D0).days: r.trend for r in f(h, ["k"], "date", "v").collect()} for f in (forecast.decompose, forecast.decompose_robust)]
    near = [i for i in range(67, 74) if i != 70]
    moved = [max(abs(parts["wild"][k][i] - parts["clean"][k][i]) for i in near) for k in (0, 1)]
    assert moved[1] < 0.05 * moved[0]


def test_robust_parts_add_up_and_bear_nulls(spark):
    h = history(spark, [(i, None if i in (3, 50) else float(i % 7)) for i in range(60)]).unionByName(history(spark, [(i, None) for i in range(9)], "none")).unionByName(history(spark, [(0, 1.0)], "one"))
    rows = forecast.decompose_robust(h, ["k"], "date", "v").collect()
    assert len(rows) == 70
    for r in rows:
        if r.v is None:
            assert r.residual is None
        else:
            assert r.v == pytest.approx(r.trend + r.seasonal + r.residual, abs=1e-9)
