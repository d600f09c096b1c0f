"""Queries: attribution and what-if, on fitted models and on a fixed linear formula."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.columns import non_negative
from panelweave.operators import attribution, boosting, models, tree_attribution, whatif
from panelweave.operators.whatif import Change, interpret
from panelweave.plans.forecast_queries import (
    LINEAR_INTERCEPT,
    LINEAR_WEIGHTS,
    TREE_FEATURES,
    model_rows,
    regression,
    test_rows,
    train,
    tree_scorer,
    trees,
)
from panelweave.plans.registry import query, six
from panelweave.session import measured
from panelweave.sources.retail import KEYS, SNAPS

ROW = [*KEYS, "date"]
LINEAR_FEATURES = list(LINEAR_WEIGHTS)

# Relative price changes of the named scenarios, and the price sweep.
SCENARIOS = {
    "price_up": [Change("sell_price", "multiply", 1.10)],
    "promotion": [Change("sell_price", "multiply", 0.80)],
    "snap_active": [Change(s, "replace", 1) for s in SNAPS],
}
PRICES = [1.0 + 0.25 * i for i in range(20)]

# Perturbations as a caller may give them: a relative price change and a flag set to 1.
PERTURBATIONS = {"sell_price": 0.1, "snap_A": 1, "no_such_feature": 5}


def linear_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows of the fixed formula, missing values as 0."""
    rows = test_rows(spark, sf_dir).select(*ROW, "sales", *LINEAR_FEATURES)
    return rows.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in LINEAR_FEATURES})


def linear_scorer(df: DataFrame) -> DataFrame:
    return df.withColumn("yhat", non_negative(attribution.linear_score(LINEAR_WEIGHTS, LINEAR_INTERCEPT)))


# ---- attribution of the fixed formula

CONTRIBUTIONS = """
    SELECT item_id, store_id, date, lag_7, sell_price, snap_A, 2.0 + 0.5 * m_lag - 0.001 * m_price + 1.5 * m_snap AS base_value,
           0.5 * (lag_7 - m_lag) AS contrib_lag_7, -0.001 * (sell_price - m_price) AS contrib_sell_price,
           1.5 * (snap_A - m_snap) AS contrib_snap_A, raw AS prediction
    FROM scored, (SELECT avg(lag_7) AS m_lag, avg(sell_price) AS m_price, avg(snap_A) AS m_snap FROM scored)"""
CONTRIBUTED = ["base_value", *[f"contrib_{f}" for f in LINEAR_FEATURES], "prediction"]
GLOBAL = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg(abs(contrib_{f})) AS mean_abs_contribution FROM c" for f in LINEAR_FEATURES
)


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.linear_contributions(linear_rows(spark, sf_dir), ROW, LINEAR_WEIGHTS, LINEAR_INTERCEPT)


@query("attribution_rows_linear", CONTRIBUTIONS, ("scored",), six(*CONTRIBUTED))
def attribution_rows_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contributions(spark, sf_dir)


@query(
    "attribution_global_linear",
    f"WITH c AS ({CONTRIBUTIONS}) {GLOBAL}",
    ("scored",),
    six("mean_abs_contribution"),
)
def attribution_global_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.global_ranking(contributions(spark, sf_dir), LINEAR_FEATURES, 15)


@query(
    "dependence_table_linear",
    f"""WITH c AS ({CONTRIBUTIONS}) SELECT floor(lag_7 / 5.0) * 5.0 AS bin_start, avg(contrib_lag_7) AS mean_contribution,
        count(*) AS n_rows, avg(sell_price) AS mean_sell_price FROM c GROUP BY 1""",
    ("scored",),
    six("mean_contribution", "mean_sell_price"),
)
def dependence_table_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.dependence(contributions(spark, sf_dir), "lag_7", 5.0, "sell_price")


@query(
    "importance_normalised_linear",
    f"""WITH c AS ({CONTRIBUTIONS}), g AS ({GLOBAL}), s AS (SELECT sum(mean_abs_contribution) AS s, count(*) AS n, median(mean_abs_contribution) AS m FROM g)
        SELECT feature, mean_abs_contribution, mean_abs_contribution / (s + 1e-8) AS share,
               mean_abs_contribution / (s + 1e-8) > 1 / n AS above_even_share, mean_abs_contribution > m AS above_median FROM g, s""",
    ("scored",),
    six("mean_abs_contribution", "share"),
)
def importance_normalised_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.normalise_importance(attribution_global_linear(spark, sf_dir), "mean_abs_contribution")


HASH = "CAST('0x' || substr(md5('42|' || item_id || '|' || store_id || '|' || CAST(date AS VARCHAR)), 1, 8) AS BIGINT)"
PERMUTED = " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, sqrt(avg(pow(sales - greatest(0.0, raw - {w} * {f} + {w} * shifted), 2))) AS permuted_rmse
        FROM (SELECT *, coalesce(lead({f}) OVER w, first_value({f}) OVER w) AS shifted FROM hashed WINDOW w AS (ORDER BY h, item_id, store_id, date))"""
    for f, w in LINEAR_WEIGHTS.items()
)


@query(
    "permutation_importance_linear",
    f"""WITH hashed AS (SELECT scored.*, {HASH} AS h FROM scored), p AS ({PERMUTED})
        SELECT feature, permuted_rmse, permuted_rmse - (SELECT sqrt(avg(pow(sales - greatest(0.0, raw), 2))) FROM scored) AS importance FROM p""",
    ("scored",),
    six("permuted_rmse", "importance"),
)
def permutation_importance_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.permutation_importance(linear_rows(spark, sf_dir), ROW, LINEAR_FEATURES, "sales", linear_scorer)


# ---- what-if of the fixed formula


@query(
    "what_if_linear",
    """SELECT item_id, store_id, date, baseline, counterfactual, counterfactual - baseline AS impact_absolute,
              (counterfactual - baseline) / (abs(baseline) + 1e-8) * 100 AS impact_relative_pct
       FROM (SELECT *, greatest(0.0, raw) AS baseline,
                    greatest(0.0, 2.0 + 0.5 * lag_7 - 0.001 * (sell_price * 1.1) + 1.5 * 1) AS counterfactual FROM scored)""",
    ("scored",),
    {**six("baseline", "counterfactual", "impact_absolute"), "impact_relative_pct": 2},
)
def what_if_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = [interpret(f, v) for f, v in PERTURBATIONS.items()]
    out = whatif.what_if(linear_rows(spark, sf_dir), linear_scorer, changes)
    return out.select(*ROW, "baseline", "counterfactual", "impact_absolute", "impact_relative_pct")


@query(
    "what_if_scenarios_linear",
    """WITH m AS (
         SELECT 'baseline' AS scenario, avg(greatest(0.0, raw)) AS mean_forecast, count(*) AS n_rows FROM scored
         UNION ALL SELECT 'price_up', avg(greatest(0.0, raw - 0.001 * (sell_price * 1.10 - sell_price))), count(*) FROM scored
         UNION ALL SELECT 'promotion', avg(greatest(0.0, raw - 0.001 * (sell_price * 0.80 - sell_price))), count(*) FROM scored
         UNION ALL SELECT 'snap_active', avg(greatest(0.0, raw + 1.5 * (1 - snap_A))), count(*) FROM scored)
       SELECT *, mean_forecast - (SELECT mean_forecast FROM m WHERE scenario = 'baseline') AS delta FROM m""",
    ("scored",),
    six("mean_forecast", "delta"),
)
def what_if_scenarios_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whatif.compare_scenarios(linear_rows(spark, sf_dir), linear_scorer, SCENARIOS)


@query(
    "scenario_sweep_linear",
    """SELECT 'baseline' AS scenario, CAST(NULL AS DOUBLE) AS sweep_value, avg(greatest(0.0, raw)) AS mean_forecast FROM scored
       UNION ALL SELECT 'sell_price', v, avg(greatest(0.0, raw - 0.001 * (v - sell_price)))
       FROM scored CROSS JOIN (SELECT CAST(1.0 + 0.25 * i AS DOUBLE) AS v FROM range(0, 20) AS r(i)) GROUP BY v""",
    ("scored",),
    six("mean_forecast"),
)
def scenario_sweep_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whatif.sweep(linear_rows(spark, sf_dir), linear_scorer, "sell_price", PRICES)


# ---- the same on fitted models

REGRESSION_FEATURES = TREE_FEATURES


def fitted_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions of the linear regression over all series and all model features."""
    weights, intercept = regression(spark, sf_dir)
    rows = model_rows(test_rows(spark, sf_dir)).select(*ROW, *[F.col(f).cast("double").alias(f) for f in REGRESSION_FEATURES])
    return attribution.linear_contributions(rows, ROW, weights, intercept)


@query("attribution_rows")
def attribution_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted_contributions(spark, sf_dir)


@query("attribution_global")
def attribution_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.global_ranking(fitted_contributions(spark, sf_dir), REGRESSION_FEATURES, 15)


@query("dependence_table")
def dependence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.dependence(fitted_contributions(spark, sf_dir), "lag_7", 5.0, "roll_mean_28")


@query("importance_normalised")
def importance_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = models.importances(trees(spark, sf_dir), TREE_FEATURES)
    return attribution.normalise_importance(weights, "importance")


def tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return test_rows(spark, sf_dir).select(*ROW, "sales", *TREE_FEATURES)


@query("permutation_importance")
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.permutation_importance(
        tree_rows(spark, sf_dir), ROW, TREE_FEATURES, "sales", tree_scorer(spark, sf_dir)
    )


@query("what_if")
def what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = [interpret(f, v) for f, v in PERTURBATIONS.items()]
    out = whatif.what_if(tree_rows(spark, sf_dir), tree_scorer(spark, sf_dir), changes)
    return out.select(*ROW, "baseline", "counterfactual", "impact_absolute", "impact_relative_pct")


@query("what_if_scenarios")
def what_if_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whatif.compare_scenarios(tree_rows(spark, sf_dir), tree_scorer(spark, sf_dir), SCENARIOS)


@query("scenario_sweep")
def scenario_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whatif.sweep(tree_rows(spark, sf_dir), tree_scorer(spark, sf_dir), "sell_price", PRICES)


# ---- contributions of the boosted trees


def tree_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = tree_attribution.trees_of(spark, trees(spark, sf_dir).stages[-1])
    return tree_attribution.tree_contributions(model_rows(tree_rows(spark, sf_dir)), ROW, TREE_FEATURES, grown)


@query("attribution_trees")
def attribution_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_contributions(spark, sf_dir)


@query("attribution_trees_global")
def attribution_trees_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.global_ranking(tree_contributions(spark, sf_dir), TREE_FEATURES, 15)


@query(
    "attribution_trees_sums",
    "SELECT item_id, store_id, count(*) AS n_rows, count(*) AS n_adding_up FROM gold WHERE split = 'test' GROUP BY 1, 2",
    ("gold",),
)
def attribution_trees_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose base value and contributions add up to what the fitted model itself predicts."""
    told = tree_contributions(spark, sf_dir).withColumnRenamed("prediction", "told")
    total = sum((F.col(f"contrib_{f}") for f in TREE_FEATURES), F.col("base_value"))
    scored = trees(spark, sf_dir).transform(told)
    same = (F.abs(F.col("prediction") - total) < 1e-6) & (F.abs(F.col("prediction") - F.col("told")) < 1e-6)
    return scored.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(same).alias("n_adding_up"))


# ---- what must hold for the fitted models, whatever was fitted


MOMENT_FEATURES = ["lag_1", "lag_28", "roll_mean_28", "day_of_week", "snap_A", "te_store_id"]


@query(
    "regression_moments",
    "WITH c AS (SELECT * FROM gold WHERE split = 'train' AND roll_std_7 IS NOT NULL) SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, sum(sales * {f}) / sum({f} * {f}) AS moment FROM c" for f in MOMENT_FEATURES)
    + " UNION ALL SELECT '(one)', avg(sales) FROM c)",
    ("gold",),
    {"moment": 4},
)
def regression_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares leaves residuals that no feature explains: sums of fit times feature are those
    of value times feature."""
    weights, intercept = regression(spark, sf_dir)
    rows = model_rows(train(spark, sf_dir)).select("sales", *TREE_FEATURES).dropna()
    fitted = rows.withColumn("fit", attribution.linear_score(weights, intercept))
    sums = fitted.agg(*[(F.sum(F.col("fit") * F.col(f)) / F.sum(F.col(f) * F.col(f))).alias(f) for f in MOMENT_FEATURES], F.avg("fit").alias("(one)"))
    return sums.unpivot([], [*MOMENT_FEATURES, "(one)"], "feature", "moment")


@query("importance_totals", "SELECT 'gbt' AS model, CAST(22 AS BIGINT) AS n_features, true AS sums_to_one, true AS none_negative, count(*) >= 0 AS ordered FROM gold", ("gold",))
def importance_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importances are shares: one per feature, none negative, and in falling order."""
    table = models.importances(trees(spark, sf_dir), TREE_FEATURES)
    listed = [r["importance"] for r in table.collect()]  # a row per feature
    falling = all(a >= b for a, b in zip(listed, listed[1:]))
    return table.agg(
        F.lit("gbt").alias("model"), F.count_distinct("feature").alias("n_features"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"),
        (F.min("importance") >= 0).alias("none_negative"), F.lit(falling).alias("ordered"),
    )


@query(
    "first_tree_totals",
    "SELECT count(*) AS n_rows, sum(sales) AS total FROM gold WHERE split = 'train' AND roll_std_7 IS NOT NULL",
    ("gold",),
    {"total": 3},
)
def first_tree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree on all rows: its leaves are means, so predictions have the sum of the values."""
    rows = model_rows(train(spark, sf_dir))
    one = boosting.boost(rows, TREE_FEATURES, "sales", F.lit(False), rounds=1, params=boosting.TreeParams(row_share=1.0))
    scored = one.model.transform(rows.select("sales", *TREE_FEATURES).dropna())
    return scored.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("prediction").alias("total"))


@query(
    "scenario_baselines",
    """SELECT 'scenarios' AS source, count(*) AS n_rows, true AS baseline_is_mean_forecast FROM gold WHERE split = 'test'
       UNION ALL SELECT 'sweep', count(*), true FROM gold WHERE split = 'test'
       UNION ALL SELECT 'what_if', count(*), true FROM gold WHERE split = 'test'""",
    ("gold",),
)
def scenario_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baselines of the scenarios, the sweep and the what-if are the model's own forecasts."""
    scored = tree_scorer(spark, sf_dir)(tree_rows(spark, sf_dir)).agg(F.avg("yhat").alias("own"), F.count(F.lit(1)).alias("n_rows"))
    own = measured(scored)
    baselines = {
        "scenarios": what_if_scenarios(spark, sf_dir).filter("scenario = 'baseline'").select(F.col("mean_forecast").alias("told")),
        "sweep": scenario_sweep(spark, sf_dir).filter("scenario = 'baseline'").select(F.col("mean_forecast").alias("told")),
        "what_if": what_if(spark, sf_dir).agg(F.avg("baseline").alias("told")),
    }
    out = None
    for name, told in baselines.items():
        row = told.select(F.lit(name).alias("source"), own.select("n_rows").scalar().alias("n_rows"), (F.abs(F.col("told") - own.select("own").scalar()) < 1e-6).alias("baseline_is_mean_forecast"))
        out = row if out is None else out.unionByName(row)
    return out
