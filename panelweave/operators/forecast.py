"""Forecasts as Spark jobs. Every forecaster returns the series keys, ``ds`` and ``yhat``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

from panelweave.functions.columns import EPSILON, calendar_parts

# Fixed value: standard normal quantile of a two-sided 95% interval.
Z_95 = 1.96


def last_dates(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(date).alias("last_date"))


def _next_days(last: Column, horizon: int) -> Column:
    return F.explode(F.sequence(F.date_add(last, 1), F.date_add(last, horizon)))


def future_dates(last: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """The ``horizon`` days after each series' last date; a narrow expansion."""
    return last.select(*keys, _next_days(F.col("last_date"), horizon).alias("ds"))


def future_frame(
    history: DataFrame,
    keys: Sequence[str],
    date: str,
    horizon: int,
    price: str = "sell_price",
    zero_flags: Sequence[str] = (),
    event_code: int = 0,
) -> DataFrame:
    """Future days with covariates: calendar parts, last known price, flags at 0 and the
    code that stands for "no event"."""
    known = F.struct(date, price)
    last = history.groupBy(*keys).agg(
        F.max(date).alias("last_date"),
        F.max(F.when(F.col(price).isNotNull(), known))[price].alias(price),
    )
    return (
        last.select(*keys, price, _next_days(F.col("last_date"), horizon).alias("ds"))
        .withColumns(calendar_parts("ds"))
        .withColumns({flag: F.lit(0) for flag in zero_flags})
        .withColumn("event_name_encoded", F.lit(event_code))
    )


def seasonal_naive(history: DataFrame, keys: Sequence[str], date: str, value: str, horizon: int, season: int = 7) -> DataFrame:
    """Repeat the last observed value of the same phase of the season: ``horizon`` rows for every
    series with an observed value.

    A phase that the history lacks gets the mean of the series. A series is one small row (its
    last day, its mean, the last value by phase) that is expanded to the future days, so
    nothing is joined. Null values are no observations.
    """
    phase = F.pmod(F.datediff(date, F.lit("1970-01-01")), F.lit(season))
    by_phase = history.groupBy(*keys, phase.alias("_phase")).agg(
        F.max(date).alias("_end"),
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(date))).alias("_last"),
        F.sum(F.col(value).cast("double")).alias("_sum"),
        F.count(value).alias("_n"),
    )
    known = F.when(F.col("_last").isNotNull(), F.struct("_phase", "_last"))
    one = by_phase.groupBy(*keys).agg(
        F.max("_end").alias("_end"), F.map_from_entries(F.collect_list(known)).alias("_known"), (F.sum("_sum") / F.sum("_n")).alias("_level"), F.sum("_n").alias("_n")
    )
    ahead = one.filter("_n > 0").select(*keys, "_known", "_level", _next_days(F.col("_end"), horizon).alias("ds"))
    return ahead.select(*keys, "ds", F.coalesce(F.col("_known")[F.pmod(F.datediff("ds", F.lit("1970-01-01")), F.lit(season))], F.col("_level")).alias("yhat"))


def constant_forecast(history: DataFrame, keys: Sequence[str], date: str, level: Column, horizon: int) -> DataFrame:
    """One aggregated level per series (mean, last value, ...) repeated over the horizon."""
    levels = history.groupBy(*keys).agg(F.max(date).alias("_end"), level.alias("yhat"))
    return levels.select(*keys, _next_days(F.col("_end"), horizon).alias("ds"), "yhat")


def quantile_forecast(
    history: DataFrame, keys: Sequence[str], date: str, value: str, horizon: int, quantiles: Sequence[float]
) -> DataFrame:
    """Exact quantiles of each series' history, one row per day and quantile."""
    levels = history.groupBy(*keys).agg(
        F.max(date).alias("_end"), F.percentile(value, list(quantiles)).alias("_q")
    )
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(float(q)) for q in quantiles]).alias("quantile"), F.col("_q").alias("yhat")))
    return (
        levels.select(*keys, "_end", pairs.alias("_p"))
        .select(*keys, _next_days(F.col("_end"), horizon).alias("ds"), F.col("_p.quantile").alias("quantile"), F.col("_p.yhat").alias("yhat"))
    )


@dataclass(frozen=True)
class SeasonalModel:
    """Trend with weekly and yearly terms, fitted by ridge least squares.

    ``multiplicative`` fits the logarithm of 1 + value, so that seasons and regressors scale with the
    trend; the fit is scaled back so that it has the sum of the observations. The trend is
    linear with ``changes`` places, even over the first ``change_range`` of the history, where its
    slope may change; ``change_ridge`` is the penalty on those changes, ``ridge`` that on the rest.
    """

    multiplicative: bool = False
    changes: int = 0
    change_range: float = 0.8
    change_ridge: float = 1.0
    ridge: float = 1.0

    def design(self, day: np.ndarray, origin: float, span: float, regressors: np.ndarray) -> np.ndarray:
        """Intercept, trend, its changes of slope, weekly (3) and yearly (4) Fourier pairs, regressors."""
        t = (day - origin) / span
        knots = np.linspace(0, self.change_range, self.changes + 1)[1:]
        columns = [np.ones_like(day), t, *[np.maximum(0, t - k) for k in knots]]
        for period, order in ((7.0, 3), (365.25, 4)):
            for k in range(1, order + 1):
                angle = 2 * np.pi * k * day / period
                columns += [np.sin(angle), np.cos(angle)]
        return np.column_stack(columns + ([regressors] if regressors.size else []))

    def fit(self, days: np.ndarray, y: np.ndarray, regressors: np.ndarray) -> SeasonalFit:
        if len(y) < 2:
            raise ValueError("a series needs at least two observations")
        if self.multiplicative and (y < 0).any():
            raise ValueError("a multiplicative fit needs values of at least 0")
        origin, span = float(days.min()), max(1.0, float(np.ptp(days)))
        x = self.design(days, origin, span, regressors)
        penalty = np.full(x.shape[1], self.ridge)
        penalty[2 : 2 + self.changes] = self.change_ridge
        penalty[0] = 0.0
        target = np.log1p(y) if self.multiplicative else y
        beta = np.linalg.solve(x.T @ x + np.diag(penalty), x.T @ target)
        line = x @ beta
        scale = 1.0
        if self.multiplicative:
            total = float(np.clip(np.expm1(line), 0, None).sum())
            scale = float(y.sum()) / total if total > 0 else 0.0
        if not np.isfinite([*beta, scale]).all():
            raise ValueError("the fit is not finite")
        return SeasonalFit(self, beta, origin, span, float(np.std(target - line)), scale)


@dataclass(frozen=True)
class SeasonalFit:
    model: SeasonalModel
    beta: np.ndarray
    origin: float
    span: float
    spread: float
    scale: float

    def predict(self, days: np.ndarray, regressors: np.ndarray, deviations: float = 0.0) -> np.ndarray:
        line = self.model.design(days, self.origin, self.span, regressors) @ self.beta + deviations * self.spread
        if not self.model.multiplicative:
            return line
        value = self.scale * np.clip(np.expm1(line), 0, None)
        if not np.isfinite(value).all():
            raise ValueError("the forecast is not finite")
        return value

    def slopes(self) -> list[tuple[float, float]]:
        """Day and size of each change of slope, per day."""
        knots = np.linspace(0, self.model.change_range, self.model.changes + 1)[1:]
        return [(self.origin + k * self.span, b / self.span) for k, b in zip(knots, self.beta[2 : 2 + self.model.changes])]


def _days(stamps) -> np.ndarray:
    return np.asarray(stamps, dtype="datetime64[D]").astype(float)


def _regressors(pdf: pd.DataFrame, names: Sequence[str]) -> np.ndarray:
    return pdf[list(names)].ffill().bfill().fillna(0.0).to_numpy(float)


def seasonal_regression(
    history: DataFrame,
    keys: Sequence[str],
    date: str,
    value: str,
    horizon: int,
    last_value_regressors: Sequence[str] = (),
    zero_regressors: Sequence[str] = (),
    ridge: float = 1.0,
    model: SeasonalModel | None = None,
) -> DataFrame:
    """Per-series trend and seasonality with a 95% interval, clipped at 0.

    Regressors go on with their last value or with 0. Rows without a value are left out of the
    fit. A series that cannot be fitted gets a zero forecast and its ``status`` says why. One group holds one series, at most one row
    per day.
    """
    model = model or SeasonalModel(ridge=ridge)
    regressors = [*last_value_regressors, *zero_regressors]
    key_fields = [history.schema[k] for k in keys]
    schema = StructType(
        [
            *key_fields,
            StructField("ds", DateType()),
            StructField("yhat", DoubleType()),
            StructField("yhat_lower", DoubleType()),
            StructField("yhat_upper", DoubleType()),
            StructField("status", StringType()),
        ]
    )

    def forecast(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        stamps = pd.to_datetime(pdf[date])
        ds = pd.date_range(stamps.iloc[-1] + pd.Timedelta(days=1), periods=horizon, freq="D")
        try:
            x = _regressors(pdf, regressors)
            ahead = np.zeros((horizon, len(regressors)))
            ahead[:, : len(last_value_regressors)] = x[-1, : len(last_value_regressors)]
            y = pdf[value].to_numpy(float)
            seen = np.isfinite(y)
            fit = model.fit(_days(stamps)[seen], y[seen], x[seen])
            yhat, lower, upper = (fit.predict(_days(ds), ahead, z) for z in (0.0, -Z_95, Z_95))
            status = "ok"
        except Exception as error:
            yhat = lower = upper = np.zeros(horizon)
            status = f"failed: {error}"
        out = {k: [pdf[k].iloc[0]] * horizon for k in keys}
        out |= {
            "ds": ds.date,
            "yhat": np.clip(yhat, 0, None),
            "yhat_lower": np.clip(lower, 0, None),
            "yhat_upper": np.clip(upper, 0, None),
            "status": status,
        }
        return pd.DataFrame(out)

    return history.select(*keys, date, value, *regressors).groupBy(*keys).applyInPandas(forecast, schema)


def seasonal_fitted(
    history: DataFrame, keys: Sequence[str], date: str, value: str, regressors: Sequence[str] = (), model: SeasonalModel | None = None
) -> DataFrame:
    """What the model of ``seasonal_regression`` says of the days it was fitted on, as ``fitted`` (not
    clipped, so that it has the sum of the values); null where a value is missing, and throughout
    a series that cannot be fitted."""
    model = model or SeasonalModel()
    rows = history.select(*keys, date, value, *regressors)
    schema = StructType([*[history.schema[c] for c in (*keys, date, value)], StructField("fitted", DoubleType())])

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        days, y, x = _days(pd.to_datetime(pdf[date])), pdf[value].to_numpy(float), _regressors(pdf, regressors)
        seen = np.isfinite(y)
        told = np.full(len(y), np.nan)
        try:
            told[seen] = model.fit(days[seen], y[seen], x[seen]).predict(days[seen], x[seen])
        except ValueError:
            pass
        return pdf[[*keys, date, value]].assign(fitted=pd.Series(told, pdf.index).astype(object).where(np.isfinite(told), None))

    return rows.groupBy(*keys).applyInPandas(fitted, schema)


def failed_series(forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Series and failures by status, so that fallbacks do not pass unseen."""
    per_series = forecasts.groupBy(*keys).agg(F.first("status").alias("status"))
    return per_series.groupBy("status").agg(F.count(F.lit(1)).alias("n_series"))


def decompose(
    df: DataFrame, keys: Sequence[str], order: str, value: str, period: int = 7, index: Column | None = None
) -> DataFrame:
    """Trend (centred moving mean), seasonal (phase mean of the detrended series, centred on
    0) and residual, for every series at once.

    ``index`` numbers the time steps (default: days); phases and moving means go by it, so a
    gap moves neither. In an even period the two ends of the mean count half, so that each
    phase has the same weight. The phase means are ``period`` conditional means over the
    series, so all steps share the one sort by series and time.
    """
    step = F.datediff(order, F.lit("1970-01-01")) if index is None else index
    series = Window.partitionBy(*keys)
    w = series.orderBy("_i")
    half = period // 2
    inner = w.rangeBetween(-(half - 1), half - 1) if period % 2 == 0 else w.rangeBetween(-half, half)
    total, n = F.sum(value).over(inner), F.count(value).over(inner)
    if period % 2 == 0:
        for end in (w.rangeBetween(-half, -half), w.rangeBetween(half, half)):
            total = total + F.coalesce(F.sum(value).over(end), F.lit(0.0)) * 0.5
            n = n + F.count(value).over(end) * 0.5
    phase_names = [f"_phase_{i}" for i in range(period)]
    means = [F.avg(F.when(F.col("_phase") == i, F.col("_detrended"))).over(series) for i in range(period)]
    filled = reduce(Column.__add__, [F.coalesce(c, F.lit(0.0)) for c in phase_names])
    present = reduce(Column.__add__, [F.col(c).isNotNull().cast("int") for c in phase_names])
    seasonal = F.element_at(F.array(*phase_names), F.col("_phase") + 1) - filled / present
    return (
        df.withColumn("_i", step.cast("bigint"))
        .withColumns({"_phase": F.pmod("_i", F.lit(period)).cast("int"), "trend": total / n})
        .withColumn("_detrended", F.col(value) - F.col("trend"))
        .withColumns(dict(zip(phase_names, means)))
        .withColumn("seasonal", seasonal)
        .withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal"))
        .drop("_i", "_phase", "_detrended", *phase_names)
    )


def decompose_robust(
    df: DataFrame, keys: Sequence[str], order: str, value: str, period: int = 7, index: Column | None = None, rounds: int = 2
) -> DataFrame:
    """The parts of ``decompose``, found so that single wild values move none of their neighbours.

    It starts from moving medians and medians by phase. Each round weights a row by the bisquare of
    its residual (0 from six times the median size of the residuals of its series on, 1e-8 added), then takes
    the weighted moving mean of the deseasonalised values and weighted phase means. Where all
    weights of a window or a phase are 0, what was there before stays. ``weight`` is that of the
    last round. All steps are windows over one sort by series and time; a series is at most one
    row per step. Nulls have no weight; a series of nulls has null parts.
    """
    step = F.datediff(order, F.lit("1970-01-01")) if index is None else index
    series = Window.partitionBy(*keys)
    near = series.orderBy("_i").rangeBetween(-(period // 2), period // 2)
    names = [f"_phase_{i}" for i in range(period)]

    def seasonal(df: DataFrame, phases: Sequence[Column]) -> DataFrame:
        """Phase values, less their mean, as ``seasonal`` of each row."""
        df = df.withColumns(dict(zip(names, phases)))
        filled = reduce(Column.__add__, [F.coalesce(F.col(c), F.lit(0.0)) for c in names])
        present = reduce(Column.__add__, [F.col(c).isNotNull().cast("int") for c in names])
        df = df.withColumn("_level", F.when(present > 0, filled / present)).withColumns({c: F.col(c) - F.col("_level") for c in names})
        return df.withColumn("seasonal", F.element_at(F.array(*names), F.col("_phase") + 1)).withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal"))

    df = df.withColumn("_i", step.cast("bigint"))
    df = df.withColumns({"_phase": F.pmod("_i", F.lit(period)).cast("int"), "_near": F.sort_array(F.collect_list(value).over(near))})
    half = F.size("_near") / 2  # a median has no sliding window of its own
    low, high = (F.get("_near", place.cast("int")) for place in (F.ceil(half) - 1, F.floor(half)))
    df = df.withColumn("trend", ((low + high) / 2).cast("double")).drop("_near")
    rest = F.col(value) - F.col("trend")
    df = seasonal(df, [F.median(F.when(F.col("_phase") == i, rest)).over(series) for i in range(period)])
    for _ in range(rounds):
        df = df.withColumn("_reach", 6 * F.median(F.abs("residual")).over(series) + EPSILON)
        size = F.col("residual") / F.col("_reach")
        df = df.withColumn("weight", F.when(F.abs("residual") < F.col("_reach"), F.pow(1 - size * size, 2)).otherwise(0.0))
        plain = F.col("weight") * (F.col(value) - F.col("seasonal"))
        total = F.sum(F.when(F.col(value).isNotNull(), F.col("weight"))).over(near)
        df = df.withColumn("trend", F.coalesce(F.when(total > 0, F.sum(plain).over(near) / total), F.col("trend")))
        rest = F.when(F.col(value).isNotNull(), F.col("weight") * (F.col(value) - F.col("trend")))
        phases = []
        for i, c in enumerate(names):
            mine = F.col("_phase") == i
            weight = F.sum(F.when(mine & F.col(value).isNotNull(), F.col("weight"))).over(series)
            phases.append(F.coalesce(F.when(weight > 0, F.sum(F.when(mine, rest)).over(series) / weight), F.col(c)))
        df = seasonal(df, phases)
    return df.drop("_i", "_phase", "_level", "_reach", *names)
