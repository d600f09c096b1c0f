"""Batch scoring and explanation of forecast requests by fitted models.

A request has ``request_id, series_id, model, horizon, overrides`` where ``overrides`` is a
map of feature values. Each gets one row per step, or one row whose ``status`` says why not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import series_id

# Accepted horizon in days.
MIN_HORIZON, MAX_HORIZON = 1, 56

INTERCEPT = "(intercept)"


@dataclass(frozen=True)
class Route:
    """Models that answer together. ``explain`` takes rows with ``model`` and the features and adds
    ``base_value`` and ``contributions`` (a map by feature), whose sum is the forecast."""

    models: tuple[str, ...]
    explain: Callable[[DataFrame], DataFrame]


def newest_rows(panel: DataFrame, keys: Sequence[str], date: str, value: str, features: Sequence[str], depth: int) -> DataFrame:
    """Per series the features of its newest row, that row's day as ``last`` and the ``recent`` values
    of up to ``depth`` rows, oldest first. A panel bucketed by series is not shuffled."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(date)))
    near = panel.select(*keys, date, value, *features).withColumn("_rank", rank).filter(F.col("_rank") <= depth)
    newest = F.max_by(F.struct(*features), date) if features else None
    kept = [newest.alias("_newest")] if features else []
    recent = F.transform(F.sort_array(F.collect_list(F.struct(date, value))), lambda r: r[value])
    rows = near.groupBy(*keys).agg(F.max(date).alias("last"), recent.alias("recent"), *kept)
    return rows.select(series_id(*keys).alias("series_id"), "last", "recent", *[F.col(f"_newest.{f}").alias(f) for f in features])


def lag_ahead(days: int, step: Column | str = "step", recent: str = "recent") -> Column:
    """The value ``days`` before a step that lies ahead. Where that is ahead as well, the same phase of
    the last known ``days`` stands for it; null where the series is too short."""
    step = F.col(step) if isinstance(step, str) else step
    back = days * F.ceil(step / days) - step  # rows before the newest one
    return F.try_element_at(F.col(recent), (-1 - back).cast("int"))


def with_overrides(df: DataFrame, features: Sequence[str], overrides: str = "overrides") -> DataFrame:
    """Replace features by the request's own values where it gives them."""
    given = {f: F.try_element_at(F.col(overrides), F.lit(f)) for f in features}
    return df.withColumns({f: F.coalesce(given[f], F.col(f).cast("double")) for f in features})


def linear_route(weights: DataFrame, names: Sequence[str]) -> Route:
    """Linear models whose weights are rows ``model, feature, weight, mean`` (a feature's mean where it
    was fitted; the intercept is the feature ``(intercept)``). The weights come to the rows by
    model, as one map each; a missing value reads as 0."""
    entry = F.struct("feature", F.struct("weight", "mean"))
    by_model = weights.groupBy("model").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("feature") != INTERCEPT, entry))).alias("_weights"),
        F.sum(F.when(F.col("feature") == INTERCEPT, F.col("weight")).otherwise(F.col("weight") * F.col("mean"))).alias("base_value"),
    )

    def explain(rows: DataFrame) -> DataFrame:
        told = rows.join(by_model, "model")
        x = F.create_map(*[v for f in rows.columns if dict(rows.dtypes)[f] == "double" for v in (F.lit(f), F.col(f))])
        part = lambda f, w: w["weight"] * (F.coalesce(F.try_element_at(x, f), F.lit(0.0)) - w["mean"])
        return told.withColumn("contributions", F.transform_values("_weights", part)).drop("_weights")

    return Route(tuple(names), explain)


def contribution_route(name: str, features: Sequence[str], contributions: Callable[[DataFrame, list[str]], DataFrame]) -> Route:
    """A model whose ``contributions(rows, keys)`` gives ``base_value`` and ``contrib_<feature>``."""

    def explain(rows: DataFrame) -> DataFrame:
        keys = [c for c in rows.columns if c not in features]
        told = contributions(rows, keys)
        parts = F.create_map(*[v for f in features for v in (F.lit(f), F.col(f"contrib_{f}"))])
        return told.withColumn("contributions", parts).drop("prediction", *[f"contrib_{f}" for f in features])

    return Route((name,), explain)


def answer(
    requests: DataFrame,
    latest: DataFrame,
    features: Sequence[str],
    routes: Sequence[Route],
    ahead: dict[str, Column] | None = None,
) -> DataFrame:
    """Answer requests, one plan for all models.

    ``latest`` has a row per ``series_id`` with ``last``, ``recent`` and the features. For each
    step the day is ``ds``; features named in ``ahead`` are written for it (lags by ``lag_ahead``,
    calendar parts of ``ds``, flags), the others keep their newest value, and the request's own
    values come last. Each row goes to the route of its model and comes back with ``yhat``
    (clipped at 0), ``base_value`` and ``contributions``. A request that cannot be answered has
    one row with step 0 and a ``status``: bad_horizon (a null one too), unknown_model or
    unknown_series. Model names are read in lower case; extra columns are not carried.
    """
    names = [m for r in routes for m in r.models]
    asked = requests.select("request_id", "series_id", F.lower("model").alias("model"), "horizon", "overrides")
    known = latest.select("series_id", "last", "recent", *features)
    rows = asked.join(known, "series_id", "left")
    status = (
        F.when(~F.coalesce(F.col("horizon").between(MIN_HORIZON, MAX_HORIZON), F.lit(False)), "bad_horizon")
        .when(~F.coalesce(F.col("model").isin(*names), F.lit(False)), "unknown_model")
        .when(F.col("last").isNull(), "unknown_series")
        .otherwise("ok")
    )
    rows = rows.withColumn("status", status)
    head = ["request_id", "series_id", "model", "status", "step", "ds"]
    refused = rows.filter("status != 'ok'").select(
        *head[:4], F.lit(0).alias("step"), F.lit(None).cast("date").alias("ds"), F.lit(None).cast("double").alias("yhat"),
        F.lit(None).cast("double").alias("base_value"), F.lit(None).cast("map<string,double>").alias("contributions"),
    )
    steps = rows.filter("status = 'ok'").withColumn("step", F.explode(F.sequence(F.lit(1), F.col("horizon").cast("int"))))
    steps = steps.withColumn("ds", F.date_add("last", F.col("step"))).withColumns(ahead or {})
    steps = with_overrides(steps, features).select(*head, *features)
    yhat = F.col("base_value") + F.aggregate(F.map_values("contributions"), F.lit(0.0), lambda a, x: a + x)
    out = refused
    for route in routes:
        told = route.explain(steps.filter(F.col("model").isin(*route.models)))
        out = out.unionByName(told.select(*head, F.greatest(F.lit(0.0), yhat).alias("yhat"), "base_value", "contributions"))
    return out


def explanations(answers: DataFrame) -> DataFrame:
    """Answered steps as rows: one per feature, and the base value as ``(base)``."""
    parts = F.map_concat(F.create_map(F.lit("(base)"), F.col("base_value")), F.col("contributions"))
    return answers.filter("status = 'ok'").select("request_id", "model", "step", F.explode(parts).alias("feature", "contribution"))
