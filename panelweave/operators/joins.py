"""Joins that enrich the fact table, and keyed alignment of forecasts with actuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.session import measured


def join_calendar(sales: DataFrame, calendar: DataFrame) -> DataFrame:
    """Attach the day's attributes on the day label. The calendar has one row per day."""
    return sales.join(measured(calendar), "d", "left").withColumn("date", F.to_date("date"))


def join_prices(sales: DataFrame, prices: DataFrame) -> DataFrame:
    """Attach the weekly price; null in weeks without one. When ``sales`` is placed by item
    and store, only the prices move."""
    return sales.join(prices, ["store_id", "item_id", "wm_yr_wk"], "left")


def align(forecasts: DataFrame, actuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Forecasts with their actuals, matched by key and day."""
    return forecasts.join(actuals, list(keys), "inner")


def unmatched(forecasts: DataFrame, actuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Forecast rows that no actual answers to."""
    return forecasts.join(actuals.select(*keys), list(keys), "left_anti")


def require_matches(aligned: DataFrame) -> DataFrame:
    """Raise when an evaluation join matched nothing; its metrics would be silent nulls."""
    if aligned.isEmpty():
        raise ValueError("no forecast row has an actual on the same series and day")
    return aligned


def missing_rows(expected: DataFrame, supplied: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys that were not supplied."""
    return expected.select(*keys).join(supplied.select(*keys), list(keys), "left_anti")
