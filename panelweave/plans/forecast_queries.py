"""Queries: forecasts, future frames, decomposition, model jobs and request scoring."""

from __future__ import annotations

import datetime as dt

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.columns import calendar_parts, hash_order
from panelweave.operators import boosting, features, forecast, models, requests, tree_attribution
from panelweave.operators.significance import union_models
from panelweave.plans import medallion
from panelweave.plans.registry import query, six
from panelweave.session import fresh_path, measured
from panelweave.sources import retail
from panelweave.sources.retail import HORIZON, KEYS, SNAPS

MODELS = ("naive7", "mean28", "last1")

# The linear formula of the deterministic scoring and what-if queries.
LINEAR_WEIGHTS = {"lag_7": 0.5, "sell_price": -0.001, "snap_A": 1.5}
LINEAR_INTERCEPT = 2.0


def train(spark: SparkSession, sf_dir: str, last_days: int | None = None) -> DataFrame:
    """Training rows; the day bound reaches the scan."""
    rows = medallion.gold(spark, sf_dir).filter(F.col("split") == "train")
    if last_days is not None:
        rows = rows.filter(F.col("date") > F.lit(retail.TRAIN_END - dt.timedelta(days=last_days)))
    return rows


def simple_forecasts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Forecasts of the validation days that SQL can make too. ``mean28`` is by definition the
    mean of the last 28 days; the others read the whole history."""
    recent = lambda days: train(spark, sf_dir, days).select(*KEYS, "date", "sales")
    return {
        "naive7": forecast.seasonal_naive(recent(None), KEYS, "date", "sales", HORIZON),
        "mean28": forecast.constant_forecast(recent(28), KEYS, "date", F.avg("sales"), HORIZON),
        "last1": forecast.constant_forecast(recent(None), KEYS, "date", F.max_by("sales", "date"), HORIZON),
    }


def all_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_models(simple_forecasts(spark, sf_dir))


@query(
    "forecast_seasonal_naive",
    "SELECT item_id, store_id, ds, yhat FROM forecasts WHERE model = 'naive7'",
    ("forecasts",),
)
def forecast_seasonal_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same weekday of the last observed week, from the whole training history."""
    history = train(spark, sf_dir).select(*KEYS, "date", "sales")
    return forecast.seasonal_naive(history, KEYS, "date", "sales", HORIZON)


@query(
    "future_frame",
    """SELECT item_id, store_id, ds, sell_price, CAST(dayofweek(ds) + 1 AS INTEGER) AS day_of_week,
              CAST(day(ds) AS INTEGER) AS day_of_month, CAST(week(ds) AS INTEGER) AS week_of_year,
              CAST(month(ds) AS INTEGER) AS month, CAST(year(ds) AS INTEGER) AS year, CAST(quarter(ds) AS INTEGER) AS quarter,
              CAST(dayofweek(ds) IN (0, 6) AS INTEGER) AS is_weekend, CAST(0 AS INTEGER) AS snap_A, CAST(0 AS INTEGER) AS snap_B, CAST(0 AS INTEGER) AS snap_C,
              CAST((SELECT count(*) FROM event_codes) AS INTEGER) AS event_name_encoded
       FROM (SELECT item_id, store_id, last_day + CAST(k AS INTEGER) AS ds, sell_price
             FROM (SELECT item_id, store_id, arg_max(sell_price, date) FILTER (sell_price IS NOT NULL) AS sell_price, max(date) AS last_day
                   FROM silver GROUP BY 1, 2) CROSS JOIN range(1, 29) AS days(k))""",
    ("silver", "event_codes"),
)
def future_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 28 days after the panel with their covariates."""
    silver = medallion.silver(spark, sf_dir)
    no_event = silver.agg(F.count_distinct("event_name_1").cast("int")).scalar()
    frame = forecast.future_frame(silver, KEYS, "date", HORIZON, zero_flags=SNAPS)
    return frame.withColumn("event_name_encoded", no_event)


# Seasons that scale with the trend, and 25 places where its slope may change.
SEASONAL = forecast.SeasonalModel(multiplicative=True, changes=25)


@query("forecast_seasonal_reg")
def forecast_seasonal_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One regression per series: trend, weekly and yearly terms, last price, benefit flags."""
    return forecast.seasonal_regression(train(spark, sf_dir), KEYS, "date", "sales", HORIZON, ["sell_price"], SNAPS, model=SEASONAL)


@query(
    "seasonal_fit_totals",
    "SELECT item_id, store_id, count(*) AS n_rows, sum(sales) AS total FROM splits WHERE split = 'train' GROUP BY 1, 2",
    ("splits",),
    {"total": 4},
)
def seasonal_fit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fits of the same model have the sum of the observations, series by series."""
    fitted = forecast.seasonal_fitted(train(spark, sf_dir), KEYS, "date", "sales", ["sell_price", *SNAPS], SEASONAL)
    return fitted.groupBy(*KEYS).agg(F.count("fitted").alias("n_rows"), F.sum("fitted").alias("total"))


@query(
    "forecast_intervals",
    "SELECT item_id, store_id, CAST(28 AS BIGINT) AS n_rows, CAST(28 AS BIGINT) AS n_ordered, max(date) + 1 AS first_day, max(date) + 28 AS last_day "
    "FROM splits WHERE split = 'train' GROUP BY 1, 2",
    ("splits",),
)
def forecast_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of each series' forecast, and how many have 0 <= lower <= forecast <= upper."""
    rows = forecast_seasonal_reg(spark, sf_dir)
    ordered = (F.col("yhat_lower") >= 0) & (F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))
    return rows.filter("status = 'ok'").groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(ordered).alias("n_ordered"), F.min("ds").alias("first_day"), F.max("ds").alias("last_day")
    )


@query(
    "forecast_fallback",
    """SELECT status, count(*) AS n_series FROM (SELECT item_id, store_id, CASE WHEN count(*) < 2
         THEN 'failed: a series needs at least two observations' ELSE 'ok' END AS status
       FROM daily WHERE date <= DATE '2001-06-03' GROUP BY 1, 2) GROUP BY status""",
    ("daily",),
)
def forecast_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits on the sparse facts, where a series may be too short, by status."""
    facts = medallion.daily(spark, sf_dir).filter(F.col("date") <= F.lit(retail.TRAIN_END))
    fitted = forecast.seasonal_regression(facts, KEYS, "date", "sales", HORIZON)
    return forecast.failed_series(fitted, KEYS)


# Phases come from the clock, so gaps in a series do not move them; in an even period the two
# ends of the moving mean count half.
DECOMPOSED = """
    WITH t AS (SELECT *, (inner_sum + outer_sum * {edge}) / (inner_n + outer_n * {edge}) AS trend, ((i % {period}) + {period}) % {period} AS phase
      FROM (SELECT *, sum({value}) OVER w AS inner_sum, count({value}) OVER w AS inner_n,
                   coalesce(sum({value}) OVER low, 0) + coalesce(sum({value}) OVER high, 0) AS outer_sum,
                   count({value}) OVER low + count({value}) OVER high AS outer_n
            FROM (SELECT {keys}, {order}, {value}, {index} AS i FROM {source})
            WINDOW w AS (PARTITION BY {keys} ORDER BY i RANGE BETWEEN {inner} PRECEDING AND {inner} FOLLOWING),
                   low AS (PARTITION BY {keys} ORDER BY i RANGE BETWEEN {half} PRECEDING AND {half} PRECEDING),
                   high AS (PARTITION BY {keys} ORDER BY i RANGE BETWEEN {half} FOLLOWING AND {half} FOLLOWING))),
    m AS (SELECT {keys}, phase, avg({value} - trend) AS phase_mean FROM t GROUP BY {keys}, phase),
    l AS (SELECT {keys}, avg(phase_mean) AS level FROM m GROUP BY {keys})
    SELECT {keys}, {order}, {value}, trend, phase_mean - level AS seasonal, {value} - trend - (phase_mean - level) AS residual
    FROM t JOIN m USING ({keys}, phase) JOIN l USING ({keys})"""


@query(
    "decompose_weekly",
    DECOMPOSED.format(keys="item_id, store_id", order="date", value="sales", period=7, half=3, inner=3, edge="0", index="date - DATE '1970-01-01'", source="panel"),
    ("panel",),
    six("trend", "seasonal", "residual"),
)
def decompose_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = medallion.silver(spark, sf_dir).select(*KEYS, "date", "sales")
    return forecast.decompose(panel, KEYS, "date", "sales")


@query(
    "decompose_hourly",
    DECOMPOSED.format(
        keys="event_type", order="hour", value="n_events", period=24, half=12, inner=11, edge="0.5", index="CAST(epoch(hour) AS BIGINT) // 3600",
        source="(SELECT event_type, date_trunc('hour', ts) AS hour, CAST(count(*) AS DOUBLE) AS n_events FROM events GROUP BY 1, 2)",
    ),
    digits=six("trend", "seasonal", "residual"),
)
def decompose_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second panel: events per hour, with a daily period."""
    hourly = retail.hourly_events(spark, sf_dir).select("event_type", "hour", F.col("n_events").cast("double").alias("n_events"))
    hours = F.expr("timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', hour)")
    return forecast.decompose(hourly, ["event_type"], "hour", "n_events", period=24, index=hours)


def robust_sql(rounds: int, keys: str = "item_id, store_id", period: int = 7, half: int = 3) -> str:
    """The robust decomposition round by round: medians first, then bisquare weights."""
    near = f"(PARTITION BY {keys} ORDER BY i RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    ctes = [
        f"t0 AS (SELECT {keys}, date, sales, i, i % {period} AS phase, median(sales) OVER {near} AS trend FROM (SELECT *, date - DATE '1970-01-01' AS i FROM panel))",
        f"m0 AS (SELECT {keys}, phase, median(sales - trend) AS m FROM t0 GROUP BY {keys}, phase)",
    ]
    for k in range(rounds + 1):
        ctes.append(f"l{k} AS (SELECT {keys}, avg(m) AS level FROM m{k} GROUP BY {keys})")
        ctes.append(f"""r{k} AS (SELECT t{k}.*, m - level AS seasonal, sales - trend - (m - level) AS residual
            FROM t{k} JOIN m{k} USING ({keys}, phase) JOIN l{k} USING ({keys}))""")
        if k < rounds:
            ctes.append(f"h{k} AS (SELECT *, 6 * median(abs(residual)) OVER (PARTITION BY {keys}) + 1e-8 AS reach FROM r{k})")
            ctes.append(f"""w{k} AS (SELECT * EXCLUDE (reach{", w, before" if k else ""}), CASE WHEN abs(residual) < reach THEN pow(1 - (residual / reach) * (residual / reach), 2) ELSE 0.0 END AS w FROM h{k})""")
            ctes.append(f"""t{k + 1} AS (SELECT {keys}, date, sales, i, phase, w, seasonal AS before,
                CASE WHEN sum(w) OVER {near} > 0 THEN sum(w * (sales - seasonal)) OVER {near} / sum(w) OVER {near} ELSE trend END AS trend FROM w{k})""")
            ctes.append(f"""m{k + 1} AS (SELECT {keys}, phase, CASE WHEN sum(w) > 0 THEN sum(w * (sales - trend)) / sum(w) ELSE any_value(before) END AS m
                FROM t{k + 1} GROUP BY {keys}, phase)""")
    return f"WITH {', '.join(ctes)} SELECT {keys}, date, sales, trend, seasonal, residual, w AS weight FROM r{rounds}"


@query("decompose_robust", robust_sql(2), ("panel",), six("trend", "seasonal", "residual", "weight"))
def decompose_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = medallion.silver(spark, sf_dir).select(*KEYS, "date", "sales")
    return forecast.decompose_robust(panel, KEYS, "date", "sales")


# ---- global model

TREE_FEATURES = [
    *medallion.LAG_COLUMNS,
    *[f"roll_{s}_{w}" for s in ("mean", "std") for w in (7, 14, 28)],
    "day_of_week",
    "month",
    "is_weekend",
    "quarter",
    "sell_price",
    "price_pct_change",
    *SNAPS,
    "event_name_encoded",
    "te_dept_id",
    "te_store_id",
]

_fitted: dict[tuple[str, ...], tuple[str, tuple[float, ...], int]] = {}


def newest_days() -> Column:
    """The training rows that stop boosting when they get worse."""
    return F.col("date") > F.lit(retail.TRAIN_END - dt.timedelta(days=HORIZON))


def model_rows(df: DataFrame) -> DataFrame:
    """Model features of all rows; a missing price reads as 0."""
    return df.fillna(0.0, subset=["sell_price", "price_pct_change"])


def boosted(spark: SparkSession, sf_dir: str) -> boosting.Boosted:
    """The boosted trees of this application, fitted once and kept in the shared folder."""
    key = (spark.sparkContext.applicationId, retail.source_key(spark, sf_dir))
    if key not in _fitted:
        path = fresh_path(spark, "trees")
        fit = boosting.boost(model_rows(train(spark, sf_dir)), TREE_FEATURES, "sales", newest_days())
        fit.model.write().save(path)
        _fitted[key] = path, fit.errors, fit.best
    path, errors, best = _fitted[key]
    return boosting.Boosted(PipelineModel.load(path), errors, best)


def trees(spark: SparkSession, sf_dir: str) -> PipelineModel:
    return boosted(spark, sf_dir).model


_regression: dict[tuple[str, str], tuple[dict[str, float], float]] = {}


def regression(spark: SparkSession, sf_dir: str) -> tuple[dict[str, float], float]:
    """Weights and intercept of a linear regression over all series and all model features, fitted
    once in an application."""
    key = (spark.sparkContext.applicationId, retail.source_key(spark, sf_dir))
    if key not in _regression:
        model = models.fit_linear(model_rows(train(spark, sf_dir)), TREE_FEATURES, "sales")
        _regression[key] = models.linear_weights(model, TREE_FEATURES)
    return _regression[key]


def tree_scorer(spark: SparkSession, sf_dir: str):
    model = trees(spark, sf_dir)
    return lambda df: models.predict(model, model_rows(df))


def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medallion.gold(spark, sf_dir).filter(F.col("split") == "test")


@query("forecast_gbt")
def forecast_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation days scored by one model over all series."""
    val = medallion.gold(spark, sf_dir).filter(F.col("split") == "val")
    scored = tree_scorer(spark, sf_dir)(val.select(*KEYS, "date", *TREE_FEATURES))
    return scored.select(*KEYS, F.col("date").alias("ds"), "yhat")


@query("top_features")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.importances(trees(spark, sf_dir), TREE_FEATURES).limit(15)


@query(
    "boosting_report",
    """SELECT count(*) FILTER (date <= DATE '2001-06-03' - 28) AS n_fit, count(*) FILTER (date > DATE '2001-06-03' - 28) AS n_held,
              true AS patience_kept, true AS best_is_least, true AS error_recomputed
       FROM gold WHERE split = 'train' AND roll_std_7 IS NOT NULL AND sales IS NOT NULL""",
    ("gold",),
)
def boosting_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stop of the boosted trees, checked: rows on both sides, rounds tried past the best one, and
    the error of the model that was kept, computed anew from its scores."""
    fit = boosted(spark, sf_dir)
    rows = model_rows(train(spark, sf_dir)).select(*TREE_FEATURES, "sales", newest_days().alias("held")).dropna()
    squared = F.pow(F.col("prediction") - F.col("sales"), 2)
    tried = len(fit.errors)
    return (
        fit.model.transform(rows)
        .agg(
            F.count_if(~F.col("held")).alias("n_fit"),
            F.count_if("held").alias("n_held"),
            F.lit(tried - fit.best >= boosting.PATIENCE or tried == boosting.ROUNDS).alias("patience_kept"),
            F.lit(fit.errors[fit.best - 1] == min(fit.errors)).alias("best_is_least"),
            F.sqrt(F.avg(F.when(F.col("held"), squared))).alias("rmse"),
        )
        .withColumn("error_recomputed", F.abs(F.col("rmse") - fit.errors[fit.best - 1]) < 1e-6)
        .drop("rmse")
    )


@query("boosting_rounds")
def boosting_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error on the newest days after each round that was tried, and which rounds were kept."""
    fit = boosted(spark, sf_dir)
    rows = [(i, e, i <= fit.best) for i, e in enumerate(fit.errors, 1)]
    return spark.createDataFrame(rows, "round int, rmse double, kept boolean")


@query("tune_gbt")
def tune_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six draws from the ranges on all model features, by successive halving: 3 rounds for all of
    them, 9 for two, 27 for one, judged on the newest training days."""
    rows = model_rows(train(spark, sf_dir))
    return boosting.search(rows, TREE_FEATURES, "sales", newest_days(), boosting.draw(6, seed=42), first_rounds=3, keep=3, rounds=27)


# ---- forecast requests

REQUEST_FEATURES = ["lag_7", "roll_mean_28", "sell_price", "snap_A"]
REQUEST_MODELS = ("linear", "Naive", "mean28", "transformer")

# Linear models as rows: model, feature, weight. Means are those of the newest rows.
WEIGHTS = [
    *[("linear", f, w) for f, w in LINEAR_WEIGHTS.items()],
    ("linear", requests.INTERCEPT, LINEAR_INTERCEPT),
    ("naive", "lag_7", 1.0),
    ("mean28", "roll_mean_28", 1.0),
]

# The newest row of each series, requests drawn from its hash, and their features step by step.
ASKED = """
    r AS (SELECT *, CAST('0x' || substr(md5('42|' || series_id), 1, 8) AS BIGINT) AS h
          FROM (SELECT item_id || '_' || store_id AS series_id, arg_max(date, date) AS last, arg_max(roll_mean_28, date) AS roll_mean_28,
                       arg_max(coalesce(sell_price, 0.0), date) AS sell_price, arg_max(lag_7, date) AS lag_7, arg_max(snap_A, date) AS snap_A
                FROM gold GROUP BY 1)),
    v AS (SELECT series_id, list(sales ORDER BY date) AS recent
          FROM (SELECT item_id || '_' || store_id AS series_id, date, sales, row_number() OVER (PARTITION BY item_id, store_id ORDER BY date DESC) AS k FROM gold)
          WHERE k <= 28 GROUP BY 1),
    q AS (SELECT 'r' || CAST(h AS VARCHAR) AS request_id, series_id, last, roll_mean_28, h,
            CASE h % 4 WHEN 0 THEN 'linear' WHEN 1 THEN 'naive' WHEN 2 THEN 'mean28' ELSE 'transformer' END AS model, h % 60 AS horizon,
            CASE WHEN h % 3 = 0 THEN CAST(h % 500 AS DOUBLE) ELSE sell_price END AS sell_price FROM r),
    s AS (SELECT *, CASE WHEN horizon NOT BETWEEN 1 AND 56 THEN 'bad_horizon' WHEN model = 'transformer' THEN 'unknown_model'
                         ELSE 'ok' END AS status FROM q),
    f AS (SELECT s.*, CAST(step AS INTEGER) AS step, recent[len(recent) - (7 * CAST(ceil(step / 7.0) AS BIGINT) - step)] AS lag_7
          FROM s JOIN v USING (series_id), unnest(CASE WHEN status = 'ok' THEN range(1, horizon + 1) ELSE [0] END) AS t(step))"""


def newest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of every series, whatever day that is."""
    gold = model_rows(medallion.gold(spark, sf_dir))
    return requests.newest_rows(gold, KEYS, "date", "sales", sorted({*REQUEST_FEATURES, *TREE_FEATURES}), 28)


def asked(latest: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """A request per series, with mixed models, horizons and price overrides."""
    h = F.col("h")
    return latest.select("series_id", hash_order(["series_id"]).alias("h")).select(
        F.concat(F.lit("r"), h.cast("string")).alias("request_id"),
        "series_id",
        F.element_at(F.array(*[F.lit(m) for m in names]), (F.pmod(h, F.lit(len(names))) + 1).cast("int")).alias("model"),
        F.pmod(h, F.lit(60)).cast("int").alias("horizon"),
        F.when(F.pmod(h, F.lit(3)) == 0, F.create_map(F.lit("sell_price"), F.pmod(h, F.lit(500)).cast("double"))).alias("overrides"),
    )


def features_ahead() -> dict[str, Column]:
    """Features of a day to come: lags over the known values, its calendar, no benefit days."""
    parts = calendar_parts("ds")
    return {
        **{f"lag_{k}": requests.lag_ahead(k) for k in features.LAGS},
        **{c: parts[c] for c in ("day_of_week", "month", "is_weekend", "quarter")},
        **{s: F.lit(0) for s in SNAPS},
    }


def weight_table(latest: DataFrame) -> DataFrame:
    """The linear models as a table, with the mean of each feature over the newest rows."""
    spark = latest.sparkSession
    used = sorted({f for _, f, _ in WEIGHTS if f != requests.INTERCEPT})
    means = latest.agg(*[F.avg(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f) for f in used]).unpivot([], used, "feature", "mean")
    table = spark.createDataFrame(WEIGHTS, "model string, feature string, weight double")
    return measured(table.join(means, "feature", "left"))


def linear_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = newest_rows(spark, sf_dir)
    route = requests.linear_route(weight_table(latest), ("linear", "naive", "mean28"))
    return requests.answer(asked(latest, REQUEST_MODELS), latest, REQUEST_FEATURES, [route], {k: v for k, v in features_ahead().items() if k in REQUEST_FEATURES})


@query(
    "score_requests",
    f"""WITH {ASKED}
       SELECT request_id, series_id, model, status, step, CASE WHEN status = 'ok' THEN CAST(last + step AS DATE) END AS ds,
              CASE WHEN status <> 'ok' THEN NULL WHEN model = 'naive' THEN greatest(0.0, lag_7)
                   WHEN model = 'mean28' THEN greatest(0.0, roll_mean_28)
                   ELSE greatest(0.0, 2.0 + 0.5 * lag_7 + -0.001 * sell_price) END AS yhat
       FROM f""",
    ("gold",),
    six("yhat"),
)
def score_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per series with mixed models, horizons and price overrides, answered by linear
    models whose weights are a table."""
    return linear_answers(spark, sf_dir).select("request_id", "series_id", "model", "status", "step", "ds", "yhat")


@query(
    "explain_requests",
    f"""WITH {ASKED},
       m AS (SELECT avg(coalesce(lag_7, 0.0)) AS m_lag, avg(roll_mean_28) AS m_roll, avg(sell_price) AS m_price, avg(snap_A) AS m_snap FROM r),
       a AS (SELECT * FROM f, m WHERE status = 'ok')
       SELECT request_id, model, step, feature, contribution FROM (
         SELECT request_id, model, step, '(base)' AS feature,
                CASE model WHEN 'linear' THEN 2.0 + 0.5 * m_lag - 0.001 * m_price + 1.5 * m_snap WHEN 'naive' THEN m_lag ELSE m_roll END AS contribution FROM a
         UNION ALL SELECT request_id, model, step, 'lag_7', CASE model WHEN 'linear' THEN 0.5 ELSE 1.0 END * (lag_7 - m_lag) FROM a WHERE model <> 'mean28'
         UNION ALL SELECT request_id, model, step, 'roll_mean_28', roll_mean_28 - m_roll FROM a WHERE model = 'mean28'
         UNION ALL SELECT request_id, model, step, 'sell_price', -0.001 * (sell_price - m_price) FROM a WHERE model = 'linear'
         UNION ALL SELECT request_id, model, step, 'snap_A', 1.5 * (0 - m_snap) FROM a WHERE model = 'linear')""",
    ("gold",),
    six("contribution"),
)
def explain_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature adds to each answered step."""
    return requests.explanations(linear_answers(spark, sf_dir))


@query("score_requests_fitted")
def score_requests_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps answered by the boosted trees and the regression over all series, with the feature that adds
    most to each. Requests with a bad horizon, which ``score_requests`` lists, have no step."""
    latest = newest_rows(spark, sf_dir)
    grown = tree_attribution.trees_of(spark, trees(spark, sf_dir).stages[-1])
    weights, intercept = regression(spark, sf_dir)
    rows = [("regression", f, w) for f, w in weights.items()] + [("regression", requests.INTERCEPT, intercept)]
    table = spark.createDataFrame(rows, "model string, feature string, weight double").withColumn("mean", F.lit(0.0))
    routes = [
        requests.contribution_route("gbt", TREE_FEATURES, lambda df, keys: tree_attribution.tree_contributions(df, keys, TREE_FEATURES, grown)),
        requests.linear_route(measured(table), ("regression",)),
    ]
    answers = requests.answer(asked(latest, ("gbt", "Regression")), latest, TREE_FEATURES, routes, features_ahead()).filter("status = 'ok'")
    most = F.array_max(F.transform(F.map_entries("contributions"), lambda e: F.struct(F.abs(e["value"]).alias("size"), e["key"].alias("feature"))))
    return answers.select("request_id", "series_id", "model", "step", "ds", "yhat", "base_value", most["feature"].alias("main_feature"))
