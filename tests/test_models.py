"""Boosting with patience, the search, exact tree contributions, and requests answered by models."""

from __future__ import annotations

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from panelweave.operators import boosting, models, requests, tree_attribution
from panelweave.operators.boosting import TreeParams


def noisy(spark, n=400, columns=4, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 10, (n, columns))
    y = 3 * x[:, 0] + x[:, 1] * x[:, -1] + rng.normal(0, 4, n)
    names = "abcdef"[:columns]
    return spark.createDataFrame([(*map(float, r), float(v), bool(i % 4 == 0)) for i, (r, v) in enumerate(zip(x, y))], ", ".join(f"{c} double" for c in names) + ", y double, newest boolean"), list(names)


# ---- patience


@pytest.mark.parametrize(
    "errors,patience,want",
    [([3, 2, 1], 2, (3, False)), ([3, 2, 4, 1, 5, 6], 2, (4, True)), ([1, 2, 2, 0], 2, (1, True)), ([1, 1, 1], 3, (1, False)), ([2, 3, 1, 1, 1, 1], 3, (3, True))],
)
def test_one_worse_round_ends_nothing(errors, patience, want):
    assert boosting.stopped_at(errors, patience) == want


def test_boosting_goes_past_the_best_round_and_comes_back(spark):
    df, names = noisy(spark)
    fit = boosting.boost(df, names, "y", F.col("newest"), rounds=60, patience=4, params=TreeParams(depth=4, rate=0.3))
    trees = fit.model.stages[-1]
    assert trees.getNumTrees == fit.best and len(fit.errors) == min(60, fit.best + 4)
    assert fit.errors[fit.best - 1] == min(fit.errors)
    assert any(b > a for a, b in zip(fit.errors, fit.errors[1 : fit.best])) or fit.best > 5
    again = fit.model.transform(df.filter("newest")).agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("y"), 2)))).first()[0]
    assert again == pytest.approx(fit.errors[fit.best - 1], abs=1e-9)


def test_rounds_are_doubled_without_changing_the_first_ones(spark):
    df, names = noisy(spark, 200)
    slow = TreeParams(depth=2, rate=0.02)
    short, long = (boosting.boost(df, names, "y", F.col("newest"), rounds=r, patience=3, params=slow) for r in (8, 20))
    assert short.errors == long.errors[:8] and long.best == 20


def test_a_cut_is_what_a_shorter_fit_gives_without_one(spark, monkeypatch, tmp_path):
    df, names = noisy(spark)
    params, plain, fits = TreeParams(depth=4, rate=0.3), TreeParams.regressor, []
    monkeypatch.setattr(TreeParams, "regressor", lambda self, rounds, seed: fits.append(rounds) or plain(self, rounds, seed))
    fit = boosting.boost(df, names, "y", F.col("newest"), rounds=60, patience=4, params=params)
    assert fits == [9 * 2**i for i in range(len(fits))] and fit.best < fits[-1]
    split = boosting.split_rows(df, names, "y", F.col("newest"))
    shorter = plain(params, fit.best, 42).fit(split.fit)
    split.release()
    fit.model.write().save(f"{tmp_path}/trees")
    for kept in (fit.model.stages[-1], PipelineModel.load(f"{tmp_path}/trees").stages[-1]):
        assert kept.toDebugString.split("\n")[1:] == shorter.toDebugString.split("\n")[1:]
    weights = {r.feature: r.importance for r in models.importances(fit.model, names).collect()}
    assert weights == pytest.approx(dict(zip(names, shorter.featureImportances.toArray())))


def test_importances_name_every_feature(spark):
    df, names = noisy(spark, 200)
    df = df.withColumn(names[-1], F.lit(1.0))
    fit = boosting.boost(df, names, "y", F.col("newest"), rounds=20, patience=3, params=TreeParams(depth=2))
    weights = {r.feature: r.importance for r in models.importances(fit.model, names).collect()}
    assert sorted(weights) == names and weights[names[-1]] == 0 < weights[names[0]]


def test_nothing_held_out(spark):
    df, names = noisy(spark, 60)
    fit = boosting.boost(df, names, "y", F.lit(False), rounds=3)
    assert fit.errors == () and fit.best == 3 == fit.model.stages[-1].getNumTrees


# ---- search


def test_draws_repeat_and_stay_in_range():
    made = boosting.draw(50, 7)
    assert made == boosting.draw(50, 7) != boosting.draw(50, 8)
    for name, (low, high) in boosting.SEARCH_SPACE.items():
        values = [getattr(p, name) for p in made]
        assert all(low - 1e-6 <= v <= high + 1e-6 for v in values) and len(set(values)) > 4


def test_losers_stop_early_and_the_winner_is_what_a_fit_gives(spark):
    df, names = noisy(spark, 300)
    candidates = boosting.draw(5, 1, {"depth": (1, 4), "rate": (0.05, 0.3)})
    rungs = []
    rows = boosting.search(df, names, "y", F.col("newest"), candidates, first_rounds=2, keep=2, rounds=8, on_rung=lambda r, n: rungs.append((r, n))).collect()
    assert rungs == [(2, 5), (4, 2), (8, 1)]
    assert sorted(r.rounds for r in rows) == [2, 2, 2, 4, 8] and rows[0].rounds == 8
    win = rows[0]
    split = boosting.split_rows(df, names, "y", F.col("newest"))
    errors = boosting.errors_by_round(candidates[win.candidate].regressor(8, 42).fit(split.fit), split.held)
    split.release()
    assert win.validation_rmse == pytest.approx(min(errors)) and errors.index(min(errors)) + 1 == win.best_round


# ---- contributions of trees


def expectation(tree, x, known, node=0):
    if tree.left[node] < 0:
        return tree.value[node]
    f, a, b = tree.feature[node], tree.left[node], tree.right[node]
    if f in known:
        return expectation(tree, x, known, a if x[f] <= tree.threshold[node] else b)
    return sum(tree.rows[c] / tree.rows[node] * expectation(tree, x, known, c) for c in (a, b))


def brute_shapley(trees, x):
    k = len(x)
    value = {s: sum(t.weight * expectation(t, x, s) for t in trees) for r in range(k + 1) for s in map(frozenset, itertools.combinations(range(k), r))}
    parts = []
    for i in range(k):
        rest = [j for j in range(k) if j != i]
        parts.append(sum(math.factorial(r) * math.factorial(k - 1 - r) / math.factorial(k) * (value[frozenset(s) | {i}] - value[frozenset(s)]) for r in range(k) for s in itertools.combinations(rest, r)))
    return value[frozenset()], parts


def test_contributions_are_shapley_values(spark):
    df, names = noisy(spark, 300, 6)
    fit = boosting.boost(df, names, "y", F.lit(False), rounds=4, params=TreeParams(depth=5, rate=0.4))
    trees = tree_attribution.trees_of(spark, fit.model.stages[-1])
    some = df.limit(12).withColumn("b", F.when(F.col("a") > 5, F.col("b"))).withColumn("row", F.monotonically_increasing_id())
    told = tree_attribution.tree_contributions(some, ["row"], names, trees).collect()
    scored = {r.row: r.prediction for r in fit.model.transform(some).collect()}
    assert len(told) == 12
    for r in told:
        x = [math.nan if r[c] is None else r[c] for c in names]
        base, parts = brute_shapley(trees, x)
        assert r.base_value == pytest.approx(base, abs=1e-9)
        assert [r[f"contrib_{c}"] for c in names] == pytest.approx(parts, abs=1e-9)
        assert r.base_value + sum(parts) == pytest.approx(scored[r.row], abs=1e-9) == pytest.approx(r.prediction, abs=1e-9)


def test_contributions_of_no_rows_and_of_a_stump(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0)] * 8, "a double, unused double, y double")
    fit = boosting.boost(df, ["a", "unused"], "y", F.lit(False), rounds=1)
    trees = tree_attribution.trees_of(spark, fit.model.stages[-1])
    assert tree_attribution.tree_contributions(df.limit(0), [], ["a", "unused"], trees).collect() == []
    got = tree_attribution.tree_contributions(df.limit(1), [], ["a", "unused"], trees).first()
    assert (got.base_value, got.contrib_a, got.contrib_unused, got.prediction) == (2.0, 0.0, 0.0, 2.0)


# ---- requests

DAY = dt.date(2020, 5, 10)


@pytest.fixture(scope="module")
def latest(spark):
    panel = [("a", "s", DAY - dt.timedelta(days=9 - i), float(i), 4.0 if i == 9 else 0.0) for i in range(10)] + [("b", "s", DAY, -9.0, 1.0)]
    df = spark.createDataFrame(panel, "item string, store string, date date, y double, z double")
    return requests.newest_rows(df.withColumn("lag_7", F.lit(0.0)), ["item", "store"], "date", "y", ["lag_7", "z"], 7)


def weights(spark):
    return spark.createDataFrame(
        [("lin", "lag_7", 1.0, 2.0), ("lin", "z", 1.0, 1.0), ("lin", requests.INTERCEPT, 0.5, None), ("zed", "z", 2.0, 0.0)],
        "model string, feature string, weight double, mean double",
    )


ASKED = "request_id string, series_id string, model string, horizon int, overrides map<string,double>, step string, status string"


def asked(spark, *rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], ASKED)


def answered(spark, latest, *rows):
    route = requests.linear_route(weights(spark), ("lin", "zed"))
    return requests.answer(asked(spark, *rows), latest, ["lag_7", "z"], [route], {"lag_7": requests.lag_ahead(7)})


def test_features_are_written_ahead_for_each_step(spark, latest):
    got = {r.step: r for r in answered(spark, latest, ("r", "a_s", "Lin", 9, None)).collect()}
    # lag 7 of step 1 is day 3 (of 0..9), of step 7 day 9; step 8 falls back to day 3 again
    assert [got[k].yhat for k in (1, 2, 7, 8, 9)] == [0.5 + 3 + 4, 0.5 + 4 + 4, 0.5 + 9 + 4, 0.5 + 3 + 4, 0.5 + 4 + 4]
    assert [got[k].ds for k in (1, 9)] == [DAY + dt.timedelta(days=1), DAY + dt.timedelta(days=9)]


def test_each_request_goes_to_its_model_or_says_why_not(spark, latest):
    rows = answered(
        spark, latest,
        ("r1", "a_s", "ZED", 1, None), ("r2", "a_s", "lin", 1, {"z": 10.0, "unknown": 1.0}), ("r3", "b_s", "lin", 1, None), ("r4", "a_s", "other", 1, None),
        ("r5", "a_s", "lin", 57, None), ("r6", "zzz", "lin", 1, None), ("r7", "a_s", "lin", None, None), ("r8", None, "lin", 1, None), ("r9", "a_s", None, 1, None),
        ("r1", "a_s", "ZED", 1, None),
    )
    got = sorted((r.request_id, r.status, r.step, r.yhat) for r in rows.collect())
    assert got == [
        ("r1", "ok", 1, 8.0), ("r1", "ok", 1, 8.0), ("r2", "ok", 1, 13.5), ("r3", "ok", 1, 1.5), ("r4", "unknown_model", 0, None), ("r5", "bad_horizon", 0, None),
        ("r6", "unknown_series", 0, None), ("r7", "bad_horizon", 0, None), ("r8", "unknown_series", 0, None), ("r9", "unknown_model", 0, None),
    ]


def test_explanations_add_up(spark, latest):
    rows = answered(spark, latest, ("r1", "a_s", "lin", 2, None), ("r2", "a_s", "other", 1, None))
    told = {(r.step, r.feature): r.contribution for r in requests.explanations(rows).collect()}
    assert told == {(1, "(base)"): 3.5, (1, "lag_7"): 1.0, (1, "z"): 3.0, (2, "(base)"): 3.5, (2, "lag_7"): 2.0, (2, "z"): 3.0}


def test_tree_route_answers_like_the_model(spark, latest):
    df, names = noisy(spark, 100, 2)
    df = df.withColumnsRenamed({"a": "lag_7", "b": "z"})
    fit = boosting.boost(df.withColumn("y", F.col("lag_7") + F.col("z")), ["lag_7", "z"], "y", F.lit(False), rounds=3)
    trees = tree_attribution.trees_of(spark, fit.model.stages[-1])
    route = requests.contribution_route("gbt", ["lag_7", "z"], lambda d, keys: tree_attribution.tree_contributions(d, keys, ["lag_7", "z"], trees))
    out = requests.answer(asked(spark, ("r", "a_s", "gbt", 3, None)), latest, ["lag_7", "z"], [route, requests.linear_route(weights(spark), ("lin",))], {"lag_7": requests.lag_ahead(7)})
    want = fit.model.transform(spark.createDataFrame([(3.0, 4.0), (4.0, 4.0), (5.0, 4.0)], "lag_7 double, z double")).collect()
    assert [r.yhat for r in out.orderBy("step").collect()] == pytest.approx([max(0, r.prediction) for r in want])
