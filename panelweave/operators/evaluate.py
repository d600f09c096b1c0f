"""Forecast errors. Every metric is an aggregate over rows ``(series, ds, model, y, yhat)``.

Scaled metrics join one scale per series, computed from the training rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import EPSILON, pinball, smape_term


def rmse(y: str = "y", yhat: str = "yhat") -> Column:
    return F.sqrt(F.avg((F.col(y) - F.col(yhat)) * (F.col(y) - F.col(yhat))))


def mae(y: str = "y", yhat: str = "yhat") -> Column:
    return F.avg(F.abs(F.col(y) - F.col(yhat)))


def smape(y: str = "y", yhat: str = "yhat") -> Column:
    return F.avg(smape_term(y, yhat)) * 100


def error_metrics(evaluated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """rmse, mae, smape and matched rows, per group or over everything."""
    return evaluated.groupBy(*by).agg(
        rmse().alias("rmse"), mae().alias("mae"), smape().alias("smape"), F.count(F.lit(1)).alias("n_rows")
    )


def seasonal_differences(df: DataFrame, keys: Sequence[str], order: str, value: str, seasonality: int = 1) -> DataFrame:
    """``diff``: change against the row one season earlier in the series."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("diff", F.col(value) - F.lag(value, seasonality).over(w))


def seasonal_scale(train: DataFrame, keys: Sequence[str], order: str, value: str, seasonality: int = 1) -> DataFrame:
    """Sums and means of the squared and absolute seasonal differences per series."""
    d = F.col("diff")
    return (
        seasonal_differences(train.select(*keys, order, value), keys, order, value, seasonality)
        .groupBy(*keys)
        .agg(
            F.sum(d * d).alias("sum_squared"),
            F.sum(F.abs(d)).alias("sum_absolute"),
            F.count(d).alias("n_differences"),
        )
        .withColumn("squared_scale", F.col("sum_squared") / F.col("n_differences") + EPSILON)
        .withColumn("absolute_scale", F.col("sum_absolute") / F.col("n_differences") + EPSILON)
    )


def all_metrics(evaluated: DataFrame, scale: DataFrame, keys: Sequence[str], by: Sequence[str] = ("model",)) -> DataFrame:
    """rmsse, mase, smape, rmse and mae per series and ``by``."""
    errors = error_metrics(evaluated, [*keys, *by])
    scaled = errors.join(scale.select(*keys, "squared_scale", "absolute_scale"), list(keys))
    return scaled.select(
        *keys,
        *by,
        F.sqrt(F.col("rmse") * F.col("rmse") / F.col("squared_scale")).alias("rmsse"),
        (F.col("mae") / F.col("absolute_scale")).alias("mase"),
        "smape",
        "rmse",
        "mae",
        "n_rows",
    )


def with_pooled_rmsse(errors: DataFrame, scale: DataFrame) -> DataFrame:
    """Add one rmsse over all rows behind each rmse: the scale pools the differences within
    each series, and none is taken across two series."""
    pooled = scale.agg((F.sum("sum_squared") / F.sum("n_differences") + EPSILON).alias("scale"))
    return errors.withColumn("rmsse", F.sqrt(F.col("rmse") * F.col("rmse") / pooled.scalar()))


def weighted_quantile_loss(evaluated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over the quantiles of their mean loss; rows carry ``quantile``."""
    per_quantile = evaluated.groupBy(*by, "quantile").agg(F.avg(pinball("y", "yhat", "quantile")).alias("_loss"))
    return per_quantile.groupBy(*by).agg(F.avg("_loss").alias("wql"), F.count(F.lit(1)).alias("n_quantiles"))


def compare_forecasts(forecasts: DataFrame, actuals: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Actuals and each model's forecast side by side, for series that every model covers."""
    covered = (
        forecasts.select(*keys, "model")
        .groupBy(*keys)
        .agg(F.count_distinct("model").alias("_models"))
        .filter(F.col("_models") == len(models))
    )
    side_by_side = forecasts.groupBy(*keys, "ds").pivot("model", list(models)).agg(F.first("yhat"))
    return actuals.join(side_by_side, [*keys, "ds"]).join(covered.select(*keys), list(keys), "left_semi")
