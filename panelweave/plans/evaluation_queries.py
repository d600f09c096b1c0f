"""Queries: forecast errors, significance tests, leaderboard and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators import evaluate, forecast, joins, leaderboard, significance
from panelweave.plans import forecast_queries, medallion
from panelweave.plans.forecast_queries import MODELS, all_forecasts, simple_forecasts, train
from panelweave.plans.registry import query, six
from panelweave.session import fresh_path, measured
from panelweave.sources import retail, tables
from panelweave.sources.retail import HORIZON, KEYS

DAY_KEYS = [*KEYS, "ds"]


def actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation actuals; only that split is read."""
    val = medallion.gold(spark, sf_dir).filter(F.col("split") == "val")
    return val.select(*KEYS, "dept_id", "cat_id", F.col("date").alias("ds"), F.col("sales").alias("y"))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.align(all_forecasts(spark, sf_dir), actuals(spark, sf_dir), DAY_KEYS)


def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column per model and row of actuals."""
    wide = significance.long_to_wide(all_forecasts(spark, sf_dir), DAY_KEYS, MODELS)
    return joins.align(wide, actuals(spark, sf_dir), DAY_KEYS)


def scale(spark: SparkSession, sf_dir: str, seasonality: int) -> DataFrame:
    return evaluate.seasonal_scale(train(spark, sf_dir), KEYS, "date", "sales", seasonality)


@query(
    "eval_join",
    "SELECT item_id, store_id, dept_id, cat_id, ds, model, y, yhat FROM evaluated",
    ("evaluated",),
    six("yhat"),
)
def eval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.require_matches(evaluated(spark, sf_dir))


@query(
    "eval_unmatched",
    """SELECT item_id, store_id, ds FROM forecasts WHERE model = 'naive7'
       EXCEPT SELECT item_id, store_id, date FROM daily""",
    ("forecasts", "daily"),
)
def eval_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast days on which the sparse facts have no row."""
    facts = medallion.daily(spark, sf_dir).withColumnRenamed("date", "ds")
    return joins.unmatched(simple_forecasts(spark, sf_dir)["naive7"], facts, DAY_KEYS).select(*DAY_KEYS)


ERRORS = ("rmse", "mae", "smape")


@query(
    "metrics_global",
    "SELECT model, sqrt(avg(sq)) AS rmse, avg(ae) AS mae, avg(sm) * 100 AS smape, count(*) AS n_rows FROM errors GROUP BY model",
    ("errors",),
    six(*ERRORS),
)
def metrics_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.error_metrics(evaluated(spark, sf_dir), ["model"])


@query(
    "metrics_by_group",
    """SELECT item_id, store_id, model, sqrt(avg(sq)) AS rmse, avg(ae) AS mae, avg(sm) * 100 AS smape, count(*) AS n_rows
       FROM errors GROUP BY 1, 2, 3""",
    ("errors",),
    six(*ERRORS),
)
def metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.error_metrics(evaluated(spark, sf_dir), [*KEYS, "model"])


@query(
    "seasonal_scale",
    "SELECT * FROM scale7",
    ("scale7",),
    six("squared_scale", "absolute_scale"),
)
def seasonal_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly differences of the training days, per series."""
    return scale(spark, sf_dir, 7)


@query(
    "metric_rmsse",
    """SELECT e.item_id, e.store_id, model, sqrt(avg(sq) / any_value(squared_scale)) AS rmsse
       FROM errors e JOIN scale1 s ON s.item_id = e.item_id AND s.store_id = e.store_id GROUP BY 1, 2, 3""",
    ("errors", "scale1"),
    six("rmsse"),
)
def metric_rmsse(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = evaluate.all_metrics(evaluated(spark, sf_dir), scale(spark, sf_dir, 1), KEYS)
    return metrics.select(*KEYS, "model", "rmsse")


@query(
    "metric_mase",
    """SELECT e.item_id, e.store_id, model, avg(ae) / any_value(absolute_scale) AS mase
       FROM errors e JOIN scale1 s ON s.item_id = e.item_id AND s.store_id = e.store_id GROUP BY 1, 2, 3""",
    ("errors", "scale1"),
    six("mase"),
)
def metric_mase(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = evaluate.all_metrics(evaluated(spark, sf_dir), scale(spark, sf_dir, 1), KEYS)
    return metrics.select(*KEYS, "model", "mase")


ALL_SQL = """SELECT e.item_id, e.store_id, {extra} model, sqrt(avg(sq) / any_value(squared_scale)) AS rmsse,
                    avg(ae) / any_value(absolute_scale) AS mase, avg(sm) * 100 AS smape, sqrt(avg(sq)) AS rmse, avg(ae) AS mae,
                    count(*) AS n_rows
             FROM errors e JOIN scale7 s ON s.item_id = e.item_id AND s.store_id = e.store_id GROUP BY ALL"""
FIVE = ("rmsse", "mase", "smape", "rmse", "mae")


@query("metrics_all", ALL_SQL.format(extra=""), ("errors", "scale7"), six(*FIVE))
def metrics_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five metrics per series and model, scaled by weekly differences."""
    return evaluate.all_metrics(evaluated(spark, sf_dir), scale(spark, sf_dir, 7), KEYS)


@query(
    "naive_by_category",
    f"""SELECT cat_id, model, avg(rmsse) AS rmsse, avg(mase) AS mase, avg(smape) AS smape, avg(rmse) AS rmse, avg(mae) AS mae,
               count(*) AS n_series FROM ({ALL_SQL.format(extra="e.cat_id,")}) GROUP BY 1, 2""",
    ("errors", "scale7"),
    six(*FIVE),
)
def naive_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well simple forecasts do in each category: series metrics, averaged."""
    per_series = evaluate.all_metrics(
        evaluated(spark, sf_dir), scale(spark, sf_dir, 7), KEYS, by=("cat_id", "model")
    )
    return per_series.groupBy("cat_id", "model").agg(
        *[F.avg(m).alias(m) for m in FIVE], F.count(F.lit(1)).alias("n_series")
    )


@query(
    "metric_rmsse_pooled",
    """SELECT model, sqrt(avg(sq) / (SELECT sum(sum_squared) / sum(n_differences) + 1e-8 FROM scale1)) AS rmsse
       FROM errors GROUP BY model""",
    ("errors", "scale1"),
    six("rmsse"),
)
def metric_rmsse_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = evaluate.error_metrics(evaluated(spark, sf_dir), ["model"])
    return evaluate.with_pooled_rmsse(errors, scale(spark, sf_dir, 1)).select("model", "rmsse")


QUANTILES = (0.1, 0.5, 0.9)


@query(
    "metric_wql",
    """WITH q AS (
         SELECT item_id, store_id, quantile, quantile_cont(sales, [0.1, 0.5, 0.9])[n] AS yhat
         FROM splits CROSS JOIN (VALUES (1, 0.1::DOUBLE), (2, 0.5::DOUBLE), (3, 0.9::DOUBLE)) AS v(n, quantile)
         WHERE split = 'train' GROUP BY item_id, store_id, quantile, n)
       SELECT cat_id, avg(loss) AS wql, count(*) AS n_quantiles FROM (
         SELECT cat_id, quantile, avg(greatest(quantile * (sales - yhat), (quantile - 1) * (sales - yhat))) AS loss
         FROM splits a JOIN q ON q.item_id = a.item_id AND q.store_id = a.store_id WHERE a.split = 'val' GROUP BY 1, 2)
       GROUP BY cat_id""",
    ("splits",),
    six("wql"),
)
def metric_wql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile loss per category of the exact quantiles of the whole training history."""
    history = train(spark, sf_dir).select(*KEYS, "date", "sales")
    quantiles = forecast.quantile_forecast(history, KEYS, "date", "sales", HORIZON, QUANTILES)
    rows = joins.align(quantiles, actuals(spark, sf_dir), DAY_KEYS)
    return evaluate.weighted_quantile_loss(rows, ["cat_id"])


# ---- significance

WIDE_SQL = """SELECT item_id, store_id, cat_id, ds, y, max(yhat) FILTER (model = 'naive7') AS naive7,
                     max(yhat) FILTER (model = 'mean28') AS mean28, max(yhat) FILTER (model = 'last1') AS last1
              FROM evaluated GROUP BY ALL"""
ERF_SQL = """((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x)"""


def _verdict_sql(source: str, columns: str) -> str:
    """Test results from ``mean`` and ``variance``; 2 (1 - Phi(z)) = erfc(z / sqrt 2)."""
    return f"""SELECT {columns}, round(stat, 4) + 0.0 AS dm_statistic, round({ERF_SQL}, 4) + 0.0 AS p_value,
                      {ERF_SQL} < 0.05 AS reject_h0_5pct, stat < 0 AS model1_better
               FROM (SELECT *, 1 / (1 + 0.3275911 * x) AS t FROM (
                 SELECT *, abs(stat) / sqrt(2.0) AS x FROM (
                   SELECT *, mean / sqrt(greatest(variance, 1e-10)) AS stat FROM ({source}))))"""


@query(
    "dm_test",
    _verdict_sql(
        f"""SELECT cat_id, avg(d) AS mean, count(d) AS n_rows, (var_samp(d) + """
        + " + ".join(f"2 * (1 - {k} / 7.0::DOUBLE) * covar_samp(d, d{k})" for k in range(1, 7))
        + f""") / count(d) AS variance FROM (SELECT cat_id, d, """
        + ", ".join(f"lag(d, {k}) OVER w AS d{k}" for k in range(1, 7))
        + f""" FROM (SELECT *, (y - naive7) * (y - naive7) - (y - mean28) * (y - mean28) AS d FROM ({WIDE_SQL}))
            WINDOW w AS (PARTITION BY item_id, store_id ORDER BY ds)) GROUP BY cat_id""",
        "cat_id, n_rows",
    ),
    ("evaluated",),
)
def dm_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same weekday against 28-day mean, per category, squared loss over 7 steps."""
    return significance.dm_test(
        side_by_side(spark, sf_dir), ["cat_id"], KEYS, "ds", "y", "naive7", "mean28", "squared", horizon=7
    )


PAIR_SQL = " UNION ALL ".join(
    f"""SELECT '{a}' AS model_1, '{b}' AS model_2, avg(d) AS mean, var_samp(d) / count(d) AS variance
        FROM (SELECT abs(y - {a}) - abs(y - {b}) AS d FROM ({WIDE_SQL}))"""
    for a, b in (("naive7", "mean28"), ("naive7", "last1"), ("mean28", "last1"))
)


@query(
    "dm_pairwise",
    f"""WITH p AS (SELECT model_1, model_2, p_value FROM ({_verdict_sql(PAIR_SQL, "model_1, model_2")}))
        SELECT * FROM p UNION ALL SELECT model_2, model_1, p_value FROM p
        UNION ALL SELECT m, m, 1.0 FROM (VALUES ('naive7'), ('mean28'), ('last1')) AS v(m)""",
    ("evaluated",),
)
def dm_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return significance.dm_pairwise(side_by_side(spark, sf_dir), "y", MODELS, "absolute")


# ---- runs and leaderboard


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged runs: each model under other metric names, one run without rmse, one open."""
    errors = evaluate.error_metrics(evaluated(spark, sf_dir), ["model"])
    metrics = measured(evaluate.with_pooled_rmsse(errors, scale(spark, sf_dir, 1)))
    of = lambda model: metrics.filter(F.col("model") == model)
    start, hour = 990_000_000_000, 3_600_000
    log = leaderboard.metrics_to_runs
    logged = leaderboard.union_runs(
        [
            log(of("naive7"), "run-0001-naive7", "naive7_weekly", start, {m: f"val_{m}" for m in ("rmsse", *ERRORS)}),
            log(of("mean28"), "run-0002-mean28", "Mean28_level", start + hour, {m: f"test_{m}" for m in ("rmsse", *ERRORS)}),
            log(of("last1"), "run-0003-last1", "last1_value", start + 2 * hour, {"rmse": "rmse", "mae": "mae", "smape": "smape_pct"}),
            log(of("mean28"), "run-0004-partial", "mean28_partial", start + 3 * hour, {"mae": "val_mae"}),
            log(of("naive7"), "run-0005-open", "naive7_open", start + 4 * hour, {"rmse": "val_rmse"}, status="RUNNING"),
        ]
    )
    return measured(logged)


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(leaderboard.leaderboard(runs(spark, sf_dir)))


@query("leaderboard", "SELECT * FROM board", ("board",))
def leaderboard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board(spark, sf_dir)


LEADERBOARD_SCHEMA = (
    "run_name string, run_id string, rmsse double, rmse double, mae double, smape double, start_time string, model_family string"
)


@query("leaderboard_csv", "SELECT * FROM board", ("board",))
def leaderboard_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "leaderboard_csv")
    tables.write_csv(board(spark, sf_dir), path)
    return tables.read_csv(spark, path, LEADERBOARD_SCHEMA)


@query("best_model", "SELECT * FROM board ORDER BY rmsse NULLS LAST, run_name LIMIT 1", ("board",))
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.best_model(board(spark, sf_dir))


RUN_LOG_SQL = """SELECT 'run-' || event_id AS run_id, event_type || '_' || user_id AS run_name,
    CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'FINISHED' END AS status, epoch_us(ts) // 1000 AS start_millis FROM events"""


def latest_sql(source: str, pattern: str) -> str:
    named = f"FROM {source} WHERE run_name LIKE '{pattern}'"
    return f"""SELECT DISTINCT run_id, run_name, status, CAST(start_millis AS BIGINT) AS start_millis {named}
       AND start_millis = (SELECT max(start_millis) {named})"""


@query("latest_run", f"{latest_sql('runs', '%ean28%')} UNION ALL {latest_sql(f'({RUN_LOG_SQL})', 'purchase%7')}", ("runs",))
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest run of a family of names, among the models' runs and in the event log, where which
    one it is, and when it began, is for the table to say. Runs that began together all count."""
    of_models = leaderboard.latest_run(runs(spark, sf_dir), "%ean28%")
    return of_models.unionByName(leaderboard.latest_run(retail.run_log(spark, sf_dir), "purchase%7"))


@query(
    "metrics_normalised",
    "WITH c AS (SELECT * FROM board WHERE rmsse IS NOT NULL AND mae IS NOT NULL AND smape IS NOT NULL) SELECT run_name, "
    + ", ".join(f"1 - {m} / ((SELECT max({m}) FROM c) + 1e-8) AS {m}_norm" for m in ("rmsse", *ERRORS))
    + " FROM c WHERE (SELECT count(*) FROM c) >= 2",
    ("board",),
    six("rmsse_norm", "rmse_norm", "mae_norm", "smape_norm"),
)
def metrics_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.normalised(board(spark, sf_dir))


@query(
    "forecast_comparison",
    f"SELECT item_id, store_id, ds, y, naive7, mean28, last1 FROM ({WIDE_SQL})",
    ("evaluated",),
    six(*MODELS),
)
def forecast_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = actuals(spark, sf_dir).select(*DAY_KEYS, "y")
    return evaluate.compare_forecasts(all_forecasts(spark, sf_dir), truth, KEYS, MODELS)


@query(
    "benchmark_run",
    """SELECT model, 'ok' AS status, CAST(NULL AS VARCHAR) AS error, sqrt(avg(sq)) AS rmse, avg(ae) AS mae, avg(sm) * 100 AS smape,
              CAST(count(*) AS DOUBLE) AS n_rows FROM errors GROUP BY model
       UNION ALL SELECT 'broken', 'failed', 'no such model', NULL, NULL, NULL, NULL""",
    ("errors",),
    six(*ERRORS),
)
def benchmark_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each named forecaster fitted and scored; a broken one does not stop the others."""

    def broken() -> DataFrame:
        raise LookupError("no such model")

    named = simple_forecasts(spark, sf_dir)
    forecasters = {name: (lambda f=f: f) for name, f in named.items()} | {"broken": broken}
    truth = actuals(spark, sf_dir)
    score = lambda f: evaluate.error_metrics(joins.require_matches(joins.align(f, truth, DAY_KEYS)))
    return leaderboard.run_benchmark(spark, forecasters, score)


@query("model_scores")
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted models (regression per series, global trees) next to the simple ones."""
    fitted = {
        "seasonal_reg": forecast_queries.forecast_seasonal_reg(spark, sf_dir).select(*DAY_KEYS, "yhat"),
        "gbt": forecast_queries.forecast_gbt(spark, sf_dir),
    }
    every = significance.union_models({**simple_forecasts(spark, sf_dir), **fitted})
    errors = evaluate.error_metrics(joins.align(every, actuals(spark, sf_dir), DAY_KEYS), ["model"])
    return evaluate.with_pooled_rmsse(errors, scale(spark, sf_dir, 1))
