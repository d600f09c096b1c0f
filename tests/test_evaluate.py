from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.functions.columns import two_sided_p_value
from panelweave.operators import evaluate, joins, leaderboard, significance

D0 = dt.date(2016, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def pairs(spark, y, p, series="s", model="m"):
    rows = [(series, day(i), model, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "k string, ds date, model string, y double, yhat double")


def test_known_errors(spark):
    r = evaluate.error_metrics(pairs(spark, [1, 2, 3, 4], [2, 3, 4, 5])).first()
    assert r.rmse == 1.0 and r.mae == 1.0 and r.n_rows == 4
    zero = evaluate.error_metrics(pairs(spark, [0, 5], [0, 5])).first()
    assert (zero.rmse, zero.mae, zero.smape) == (0.0, 0.0, 0.0)


def test_smape_is_symmetric_and_bounded(spark):
    a = evaluate.error_metrics(pairs(spark, [1, 0, 4], [3, 2, 4])).first().smape
    b = evaluate.error_metrics(pairs(spark, [3, 2, 4], [1, 0, 4])).first().smape
    assert a == pytest.approx(b) and 0 <= a <= 200


@pytest.mark.parametrize("m", [1, 7])
def test_scaled_metrics_equal_numpy(spark, m):
    rng = np.random.default_rng(1)
    train, y, p = rng.gamma(2, 3, 90), rng.gamma(2, 3, 28), rng.gamma(2, 3, 28)
    history = spark.createDataFrame([("s", day(i), float(v)) for i, v in enumerate(train)], "k string, date date, v double")
    scale = evaluate.seasonal_scale(history, ["k"], "date", "v", m)
    got = evaluate.all_metrics(pairs(spark, y, p), scale, ["k"]).first()
    diff = train[m:] - train[:-m]
    assert got.rmsse == pytest.approx(math.sqrt(np.mean((y - p) ** 2) / (np.mean(diff**2) + 1e-8)))
    assert got.mase == pytest.approx(np.mean(abs(y - p)) / (np.mean(abs(diff)) + 1e-8))
    pooled = evaluate.with_pooled_rmsse(evaluate.error_metrics(pairs(spark, y, p)), scale).first()
    assert pooled.rmsse == pytest.approx(got.rmsse)


def test_scale_never_crosses_series(spark):
    rows = [("a", day(i), 1.0) for i in range(5)] + [("b", day(i), 1000.0) for i in range(5)]
    scale = evaluate.seasonal_scale(spark.createDataFrame(rows, "k string, date date, v double"), ["k"], "date", "v")
    assert [r.sum_squared for r in scale.collect()] == [0.0, 0.0]


def test_quantile_loss(spark):
    y, q = np.array([1.0, 4.0, 2.0]), {0.1: np.array([0.0, 1.0, 3.0]), 0.9: np.array([5.0, 4.0, 1.0])}
    rows = [("s", float(level), float(a), float(b)) for level, v in q.items() for a, b in zip(y, v)]
    df = spark.createDataFrame(rows, "k string, quantile double, y double, yhat double")
    expected = np.mean([np.mean(np.maximum(level * (y - v), (level - 1) * (y - v))) for level, v in q.items()])
    assert evaluate.weighted_quantile_loss(df, ["k"]).first().wql == pytest.approx(expected)


def test_p_value_against_erfc(spark):
    z = [0.0, 0.3, 1.0, 1.96, 2.5, 4.0, -1.5]
    got = spark.createDataFrame([(v,) for v in z], "z double").select("z", two_sided_p_value(F.col("z")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), abs=3e-7)


def brute_dm(y, a, b, kind, h):
    loss = {"squared": lambda e: e**2, "absolute": abs}[kind]
    d = loss(y - a) - loss(y - b)
    gamma = np.var(d, ddof=1) + 2 * sum((1 - k / h) * np.cov(d[k:], d[:-k])[0, 1] for k in range(1, h))
    stat = d.mean() / math.sqrt(max(gamma / len(d), 1e-10))
    return stat, math.erfc(abs(stat) / math.sqrt(2))


@pytest.mark.parametrize("kind,h", [("squared", 1), ("squared", 4), ("absolute", 3)])
def test_dm_equals_numpy(spark, kind, h):
    rng = np.random.default_rng(3)
    y, a, b = rng.normal(10, 3, 80), rng.normal(10, 2, 80), rng.normal(10, 4, 80)
    rows = [("s", i, float(u), float(v), float(w)) for i, (u, v, w) in enumerate(zip(y, a, b))]
    df = spark.createDataFrame(rows, "k string, t int, y double, a double, b double")
    r = significance.dm_test(df, ["k"], ["k"], "t", "y", "a", "b", kind, h).first()
    stat, p = brute_dm(y, a, b, kind, h)
    assert r.dm_statistic == pytest.approx(stat, abs=6e-5) and r.p_value == pytest.approx(p, abs=6e-5)
    assert r.reject_h0_5pct == (p < 0.05) and r.model1_better == (stat < 0)
    mirrored = significance.dm_test(df, ["k"], ["k"], "t", "y", "b", "a", kind, h).first()
    assert mirrored.dm_statistic == -r.dm_statistic and mirrored.p_value == r.p_value
    matrix = {(x.model_1, x.model_2): x.p_value for x in significance.dm_pairwise(df, "y", ["a", "b"], kind).collect()}
    assert matrix[("a", "a")] == 1.0 and matrix[("a", "b")] == matrix[("b", "a")]
    assert matrix[("a", "b")] == pytest.approx(brute_dm(y, a, b, kind, 1)[1], abs=6e-5)


def test_unknown_loss(spark):
    with pytest.raises(ValueError, match="unknown loss"):
        significance.loss(F.col("a"), F.col("b"), "cubic")


RUNS = "run_id string, run_name string, status string, start_millis bigint, metric string, value double"


def test_leaderboard_rules(spark):
    runs = spark.createDataFrame(
        [
            ("aaaaaaaaaa", "Tree_v1", "FINISHED", 1_700_000_000_000, "rmse", 2.0),
            ("aaaaaaaaaa", "Tree_v1", "FINISHED", 1_700_000_000_000, "val_rmse", 1.00004),
            ("bbbbbbbbbb", "net_v1", "FINISHED", 1_700_000_060_000, "test_rmse", 3.0),
            ("bbbbbbbbbb", "net_v1", "FINISHED", 1_700_000_060_000, "rmsse", 0.5),
            ("cccccccccc", "none_v1", "FINISHED", 1_700_000_000_000, "mae", 0.1),
            ("dddddddddd", "open_v1", "RUNNING", 1_800_000_000_000, "rmse", 0.1),
        ],
        RUNS,
    )
    board = leaderboard.leaderboard(runs).collect()
    assert [(r.run_name, r.run_id, r.rmsse, r.rmse, r.model_family) for r in board] == [
        ("net_v1", "bbbbbbbb", 0.5, 3.0, "net"),
        ("Tree_v1", "aaaaaaaa", None, 1.0, "tree"),
    ]
    assert board[1].start_time == "2023-11-14 22:13"
    assert leaderboard.best_model(leaderboard.leaderboard(runs)).first().run_name == "net_v1"
    assert leaderboard.normalised(leaderboard.leaderboard(runs)).count() == 0
    assert leaderboard.latest_run(runs, "%v1").first().run_name == "open_v1"
    by_rmse = leaderboard.leaderboard(runs.filter("metric <> 'rmsse'")).collect()
    assert [r.run_name for r in by_rmse] == ["Tree_v1", "net_v1"]


def test_latest_run_keeps_all_that_began_together(spark):
    rows = [("a", "x_1", "FINISHED", 5, "mae", 1.0), ("a", "x_1", "FINISHED", 5, "rmse", 2.0), ("b", "x_2", "FAILED", 5, "mae", 1.0)]
    rows += [("c", "x_3", "FINISHED", 4, "mae", 1.0), ("d", "y_1", "FINISHED", 6, "mae", 1.0)]
    got = leaderboard.latest_run(spark.createDataFrame(rows, RUNS), "x%").collect()
    assert sorted((r.run_id, r.status) for r in got) == [("a", "FINISHED"), ("b", "FAILED")]


def test_joins_report_what_does_not_match(spark):
    forecasts = pairs(spark, [1, 2], [1, 2]).drop("y")
    truth = spark.createDataFrame([("s", day(1), 5.0)], "k string, ds date, y double")
    assert joins.align(forecasts, truth, ["k", "ds"]).count() == 1
    assert joins.unmatched(forecasts, truth, ["k", "ds"]).first().ds == day(0)
    with pytest.raises(ValueError, match="no forecast row"):
        joins.require_matches(joins.align(forecasts, truth.filter("k = 'other'"), ["k", "ds"]))


def test_comparison_needs_every_model(spark):
    f = pairs(spark, [1, 2], [3, 4], "s", "m1").unionByName(pairs(spark, [1, 2], [5, 6], "s", "m2"))
    f = f.unionByName(pairs(spark, [1, 2], [7, 8], "only_m1", "m1")).drop("y")
    truth = spark.createDataFrame([(k, day(0), 9.0) for k in ("s", "only_m1")], "k string, ds date, y double")
    got = evaluate.compare_forecasts(f, truth, ["k"], ["m1", "m2"]).collect()
    assert [(r.k, r.y, r.m1, r.m2) for r in got] == [("s", 9.0, 3.0, 5.0)]
