"""Exploration aggregates: distribution, zero rates, totals and price statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.ranges import quantiles
from panelweave.session import measured


def distribution(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of any column of numbers."""
    moments = df.agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    quartiles = measured(quantiles(df, value, (0.25, 0.5, 0.75)))  # one row
    p25, p50, p75 = (quartiles.select(f"q{i}").scalar() for i in range(3))
    return moments.select("n", "mean", "std", "min", p25.alias("p25"), p50.alias("p50"), p75.alias("p75"), "max")


def zero_rate(df: DataFrame, by: Sequence[str], value: str = "sales") -> DataFrame:
    """Share of zeros by group, highest first."""
    is_zero = (F.col(value) == 0).cast("int")
    return (
        df.groupBy(*by)
        .agg(
            F.avg(is_zero).alias("zero_rate"),
            F.avg(value).alias("avg_sales"),
            F.stddev_samp(value).alias("std_sales"),
            F.count(value).alias("n_obs"),
        )
        .orderBy(F.desc("zero_rate"), *by)
    )


def total_by_date(df: DataFrame, date: str = "date", value: str = "sales") -> DataFrame:
    return df.groupBy(date).agg(F.sum(value).alias("total_sales")).orderBy(date)


def monthly_mean(df: DataFrame, by: Sequence[str], date: str = "date", value: str = "sales") -> DataFrame:
    """Mean per group and month, with a ``YYYY-MM`` label."""
    month, year = F.month(date), F.year(date)
    return (
        df.groupBy(*by, year.alias("year"), month.alias("month"))
        .agg(F.avg(value).alias("avg_sales"))
        .withColumn("period", F.concat_ws("-", F.col("year").cast("string"), F.lpad(F.col("month").cast("string"), 2, "0")))
        .orderBy(*by, "year", "month")
    )


def weekday_mean(df: DataFrame, by: Sequence[str], weekday: str = "wday", value: str = "sales") -> DataFrame:
    return df.groupBy(weekday, *by).agg(F.avg(value).alias("avg_sales")).orderBy(*by, weekday)


def price_statistics(df: DataFrame, by: Sequence[str], price: str = "sell_price") -> DataFrame:
    """Mean, deviation, range and number of distinct prices. Both the moments and the
    distinct prices are combined map-side, so a group of any size is safe."""
    return (
        df.filter(F.col(price).isNotNull())
        .groupBy(*by)
        .agg(
            F.avg(price).alias("avg_price"),
            F.stddev_samp(price).alias("std_price"),
            F.min(price).alias("min_price"),
            F.max(price).alias("max_price"),
            F.countDistinct(price).alias("n_price_points"),
        )
        .orderBy(*by)
    )


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls per column, one row per column, from one pass over the table."""
    counts = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "feature", "n_nulls")


def describe_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation and range per column, from one pass over the table."""
    stats = df.agg(
        *[
            F.struct(
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in columns
        ]
    )
    return stats.unpivot([], list(columns), "feature", "_s").select(
        "feature", "_s.n", "_s.mean", "_s.std", "_s.min", "_s.max"
    )
