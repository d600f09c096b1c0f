from __future__ import annotations

import numpy as np
import pytest

from panelweave.operators import attribution, models, whatif
from panelweave.operators.whatif import Change, interpret

WEIGHTS = {"a": 2.0, "b": -1.0}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    data = [(i, float(a), float(b), float(2 * a - b + 5)) for i, (a, b) in enumerate(rng.normal(0, 3, (300, 2)))]
    return spark.createDataFrame(data, "id int, a double, b double, y double")


def scorer(df):
    return df.withColumn("yhat", attribution.linear_score(WEIGHTS, 5.0))


def test_contributions_add_up(rows):
    got = attribution.linear_contributions(rows, ["id"], WEIGHTS, 5.0).collect()
    assert all(r.prediction == pytest.approx(r.base_value + r.contrib_a + r.contrib_b) for r in got)
    mean = sum(r.prediction for r in got) / len(got)
    assert got[0].base_value == pytest.approx(mean)


def test_fitted_line_gives_back_its_weights(rows):
    weights, intercept = models.linear_weights(models.fit_linear(rows, ["a", "b"], "y"), ["a", "b"])
    assert weights == pytest.approx(WEIGHTS, abs=1e-6) and intercept == pytest.approx(5.0, abs=1e-6)


def test_ranking_and_dependence(rows):
    parts = attribution.linear_contributions(rows, ["id"], WEIGHTS, 5.0)
    ranked = attribution.global_ranking(parts, ["a", "b"], 1).collect()
    assert [r.feature for r in ranked] == ["a"]
    bins = attribution.dependence(parts, "a", 2.0, "b").collect()
    assert sum(r.n_rows for r in bins) == 300
    assert [r.mean_contribution for r in bins] == sorted(r.mean_contribution for r in bins)


def test_normalised_importance(spark):
    table = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 0.0)], "feature string, w double")
    got = {r.feature: r for r in attribution.normalise_importance(table, "w").collect()}
    assert got["a"].share == pytest.approx(0.75) and got["a"].above_even_share and not got["b"].above_even_share
    assert got["a"].above_median and not got["b"].above_median


def test_permutation_is_one_cycle_for_any_number_of_partitions(spark, rows):
    seen = []
    for n in ("1", "3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            moved = {r.id: r for r in attribution.permuted(rows, ["id"], ["a", "b"]).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        seen.append({i: r._permuted.a for i, r in moved.items()})
        assert all(r.y == pytest.approx(2 * r.a - r.b + 5) for r in moved.values())
    assert seen[0] == seen[1] == seen[2]
    at = {r.a: r.id for r in rows.collect()}
    i, steps = 0, 0
    while True:
        i, steps = at[seen[0][i]], steps + 1
        if i == 0:
            break
    assert steps == 300


def test_permutation_of_few_missing_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 2.0)], "id int, a double")
    got = sorted(str(r._permuted.a) for r in attribution.permuted(df, ["id"], ["a"]).collect())
    assert got == ["2.0", "None", "None"]
    assert attribution.permuted(df.limit(0), ["id"], ["a"]).collect() == []


def test_permutation_importance(rows):
    got = {r.feature: r.importance for r in attribution.permutation_importance(rows, ["id"], ["a", "b"], "y", scorer).collect()}
    assert got["a"] > got["b"] > 0


def test_bare_values_are_read_by_one_rule():
    kinds = {v: interpret("x", v).kind for v in (0.1, -0.5, 2.5, -1.0, 0.0)}
    assert kinds == {0.1: "relative", -0.5: "relative", 2.5: "replace", -1.0: "replace", 0.0: "replace"}
    assert interpret("x", 1.0).kind == "relative" and interpret("x", 1).kind == "replace"


def test_what_if(spark):
    df = spark.createDataFrame([(1, 10.0, 1.0)], "id int, a double, b double")
    r = whatif.what_if(df, scorer, [interpret("a", 0.1), interpret("nothing", 3)]).first()
    assert (r.baseline, r.counterfactual) == pytest.approx((24.0, 26.0))
    assert r.impact_absolute == pytest.approx(2.0) and r.impact_relative_pct == pytest.approx(2 / 24 * 100)
    with pytest.raises(ValueError, match="unknown change"):
        Change("a", "wrong", 1).apply()


def test_scenarios_and_sweep(spark):
    df = spark.createDataFrame([(1, 10.0, 1.0), (2, 20.0, 3.0)], "id int, a double, b double")
    scenarios = {"up": [Change("a", "multiply", 1.1)], "set": [Change("a", "replace", 0.0), Change("b", "replace", 0.0)]}
    got = {r.scenario: r for r in whatif.compare_scenarios(df, scorer, scenarios).collect()}
    assert got["baseline"].mean_forecast == pytest.approx(33.0) and got["baseline"].delta == 0
    assert got["up"].delta == pytest.approx(3.0) and got["set"].mean_forecast == pytest.approx(5.0)
    swept = {r.sweep_value: r.mean_forecast for r in whatif.sweep(df, scorer, "a", [0.0, 1.0]).collect()}
    assert swept == pytest.approx({None: 33.0, 0.0: 3.0, 1.0: 5.0})


def test_integer_flags_keep_their_type(spark):
    df = spark.createDataFrame([(1, 0)], "id int, flag int")
    assert dict(whatif.changed(df, [Change("flag", "replace", 1)]).dtypes)["flag"] == "int"
    assert dict(whatif.changed(df, [Change("flag", "multiply", 1.5)]).dtypes)["flag"] == "double"
