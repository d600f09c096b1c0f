"""Diebold-Mariano test of equal predictive accuracy, by group, as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import two_sided_p_value

# Floor of the variance of the mean difference, and the significance level.
MIN_VARIANCE = 1e-10
LEVEL = 0.05


def loss(y: Column, yhat: Column, kind: str) -> Column:
    if kind == "squared":
        return (y - yhat) * (y - yhat)
    if kind == "absolute":
        return F.abs(y - yhat)
    raise ValueError(f"unknown loss {kind!r}: use 'squared' or 'absolute'")


def _verdict(mean: Column, variance: Column) -> dict[str, Column]:
    statistic = mean / F.sqrt(F.greatest(variance, F.lit(MIN_VARIANCE)))
    p = two_sided_p_value(statistic)
    return {
        "dm_statistic": F.round(statistic, 4),
        "p_value": F.round(p, 4),
        "reject_h0_5pct": p < LEVEL,
        "model1_better": statistic < 0,
    }


def dm_test(
    df: DataFrame,
    by: Sequence[str],
    series: Sequence[str],
    order: str,
    y: str,
    yhat_1: str,
    yhat_2: str,
    kind: str = "squared",
    horizon: int = 1,
) -> DataFrame:
    """Test two forecasts per group; the variance carries ``horizon - 1`` autocovariances
    with Bartlett weights, taken between rows of the same series only."""
    d = loss(F.col(y), F.col(yhat_1), kind) - loss(F.col(y), F.col(yhat_2), kind)
    rows = df.select(*dict.fromkeys([*by, *series]), order, d.alias("d"))
    w = Window.partitionBy(*series).orderBy(order)
    rows = rows.select("*", *[F.lag("d", k).over(w).alias(f"d_{k}") for k in range(1, horizon)])
    gamma = F.var_samp("d")
    for k in range(1, horizon):
        gamma = gamma + 2 * (1 - k / horizon) * F.covar_samp("d", f"d_{k}")
    totals = rows.groupBy(*by).agg(
        F.avg("d").alias("_mean"), (gamma / F.count("d")).alias("_variance"), F.count("d").alias("n_rows")
    )
    verdict = _verdict(F.col("_mean"), F.col("_variance"))
    return totals.select(*by, "n_rows", *[c.alias(name) for name, c in verdict.items()])


def dm_pairwise(df: DataFrame, y: str, models: Sequence[str], kind: str = "squared") -> DataFrame:
    """p-values of every ordered model pair, 1 on the diagonal.

    Forecasts come side by side, one column per model, so all pairs are aggregates of a
    single pass; no rows are paired with each other.
    """
    pairs = list(combinations(models, 2))
    sums = []
    for i, (a, b) in enumerate(pairs):
        d = loss(F.col(y), F.col(a), kind) - loss(F.col(y), F.col(b), kind)
        sums += [F.avg(d).alias(f"_mean_{i}"), (F.var_samp(d) / F.count(d)).alias(f"_variance_{i}")]
    entry = lambda a, b, p: F.struct(F.lit(a).alias("model_1"), F.lit(b).alias("model_2"), p.alias("p_value"))
    cells = [entry(m, m, F.lit(1.0)) for m in models]
    for i, (a, b) in enumerate(pairs):
        p = _verdict(F.col(f"_mean_{i}"), F.col(f"_variance_{i}"))["p_value"]
        cells += [entry(a, b, p), entry(b, a, p)]
    return df.agg(*sums).select(F.inline(F.array(*cells)))


def long_to_wide(forecasts: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """One column per model; ``keys`` identify a forecast row."""
    columns = [F.max(F.when(F.col("model") == m, F.col("yhat"))).alias(m) for m in models]
    return forecasts.groupBy(*keys).agg(*columns)


def union_models(forecasts: dict[str, DataFrame]) -> DataFrame:
    """Named forecasts as one long table with a ``model`` column."""
    return reduce(DataFrame.unionByName, [f.withColumn("model", F.lit(m)) for m, f in forecasts.items()])
