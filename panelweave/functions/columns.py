"""Column expressions used across the operators; all stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the guard added to denominators throughout the metrics and features.
EPSILON = 1e-8

# Coefficients of Abramowitz and Stegun, formula 7.1.26 for erf.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def calendar_parts(date: Column | str) -> dict[str, Column]:
    """Calendar features of a date. Day of week runs from 1 (Sunday) to 7 (Saturday)."""
    d = column(date)
    return {
        "day_of_week": F.dayofweek(d),
        "day_of_month": F.dayofmonth(d),
        "week_of_year": F.weekofyear(d),
        "month": F.month(d),
        "year": F.year(d),
        "quarter": F.quarter(d),
        "is_weekend": F.dayofweek(d).isin(1, 7).cast("int"),
    }


def iso_week_key(date: Column | str) -> Column:
    """ISO year and week as one integer, e.g. 199501."""
    d = column(date)
    return (F.extract(F.lit("YEAROFWEEK"), d) * 100 + F.weekofyear(d)).cast("int")


def series_id(*keys: str) -> Column:
    return F.concat_ws("_", *keys)


def non_negative(c: Column | str) -> Column:
    return F.greatest(F.lit(0.0), column(c))


def smape_term(actual: Column | str, forecast: Column | str) -> Column:
    """One row's share of SMAPE, as a fraction; zero when both sides are zero."""
    y, p = column(actual), column(forecast)
    return F.abs(y - p) / ((F.abs(y) + F.abs(p)) / 2 + EPSILON)


def pinball(actual: Column | str, forecast: Column | str, quantile: Column | str) -> Column:
    """Quantile loss of one row."""
    e, q = column(actual) - column(forecast), column(quantile)
    return F.greatest(q * e, (q - 1) * e)


def normal_cdf_upper(z: Column) -> Column:
    """P(Z > z) for z >= 0; absolute error below 1.5e-7 (Spark SQL has no erf)."""
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = t * (poly + a)
    return poly * F.exp(-x * x) / 2


def two_sided_p_value(z: Column) -> Column:
    return 2 * normal_cdf_upper(F.abs(z))


def hash_order(keys: Sequence[Column | str], seed: int = 42) -> Column:
    """A uniform integer in [0, 2**32) per key and seed, equal on every engine with md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[column(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_fraction(keys: Sequence[Column | str], fraction: float, seed: int = 42) -> Column:
    """True for about ``fraction`` of the keys, always the same ones for a seed."""
    return F.pmod(hash_order(keys, seed), F.lit(1_000_000)) < F.lit(round(fraction * 1_000_000))


def epoch_millis_minute(millis: Column | str) -> Column:
    """Epoch milliseconds as ``yyyy-MM-dd HH:mm`` in UTC, whatever the session time zone."""
    seconds = F.floor(column(millis) / 1000).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.date_format(
        F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(zero, zero, zero, seconds),
        "yyyy-MM-dd HH:mm",
    )
