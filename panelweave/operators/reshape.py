"""Shape of a panel: unpivot, densify, select, slice, sample, split and combine."""

from __future__ import annotations

import datetime as dt
import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import hash_fraction, hash_order, non_negative, series_id


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def available(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns that exist, in the order asked for; warns about the others."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        warnings.warn(f"columns not in the table: {', '.join(missing)}", stacklevel=2)
    return [c for c in wanted if c in df.columns]


def unpivot_days(wide: DataFrame, ids: Sequence[str], prefix: str = "d_", day: str = "d", value: str = "sales") -> DataFrame:
    """Wide day columns to one row per series and day; a narrow operation."""
    days = columns_with_prefix(wide, prefix)
    return wide.select(*ids, *days).unpivot(list(ids), days, day, value)


def pivot_days(long: DataFrame, ids: Sequence[str], days: Sequence[str], day: str = "d", value: str = "sales") -> DataFrame:
    """One column per listed day; listing them saves the pass that would find them."""
    return long.groupBy(*ids).pivot(day, list(days)).agg(F.first(value))


def densify(
    sparse: DataFrame,
    series: DataFrame,
    keys: Sequence[str],
    date: str,
    start: dt.date,
    end: dt.date,
    fill: dict[str, float],
) -> DataFrame:
    """Every series on every day, with ``fill`` where the sparse table has no row.

    ``series`` comes from ``describe_series``, hence placed by key. The days are generated
    after that, so the dense rows are never shuffled: only the series and the sparse rows move.
    """
    grid = series.withColumn(date, F.explode(F.sequence(F.lit(start), F.lit(end))))
    values = sparse.select(*keys, date, *fill)
    return grid.join(values, [*keys, date], "left").fillna(fill)


def series_slice(df: DataFrame, **equals: str) -> DataFrame:
    """Rows that match every given value."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == F.lit(kv[1])), equals.items(), df)


def keep_series(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the wanted series. A semi join: the ids never pass through the driver."""
    return df.join(wanted.select(*keys), list(keys), "left_semi")


def distinct_series(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def describe_series(df: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """One row per series with the attributes that its key decides."""
    if not attributes:
        return distinct_series(df, keys)
    return df.groupBy(*keys).agg(*[F.any_value(a).alias(a) for a in attributes])


def long_enough(df: DataFrame, keys: Sequence[str], min_length: int) -> DataFrame:
    """Rows of the series with at least ``min_length`` rows."""
    lengths = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return keep_series(df, lengths.filter(F.col("n_rows") >= min_length), keys)


def sample_rows(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """A repeatable row sample: the hash of the row's key decides."""
    return df.filter(hash_fraction(keys, fraction, seed))


def sample_series(df: DataFrame, keys: Sequence[str], fraction: float, limit: int, seed: int = 42) -> DataFrame:
    """All rows of a repeatable sample of at most ``limit`` series."""
    chosen = (
        distinct_series(df, keys)
        .filter(hash_fraction(keys, fraction, seed))
        .orderBy(hash_order(keys, seed), *keys)
        .limit(limit)
    )
    return keep_series(df, chosen, keys)


def common_series(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Ids present in every table."""
    return reduce(lambda a, b: a.intersect(b), [t.select(*keys) for t in tables])


def tail(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each series, numbered 1..n from the newest backwards."""
    newest_first = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("age", F.row_number().over(newest_first)).filter(F.col("age") <= n)


def temporal_split(
    df: DataFrame, date: str, train_end: dt.date, val_end: dt.date, test_end: dt.date, train_start: dt.date | None = None
) -> DataFrame:
    """Label rows train, val or test by date; rows outside are dropped."""
    d = F.col(date)
    kept = df.filter(d <= F.lit(test_end))
    if train_start is not None:
        kept = kept.filter(d >= F.lit(train_start))
    return kept.withColumn(
        "split",
        F.when(d <= F.lit(train_end), "train").when(d <= F.lit(val_end), "val").otherwise("test"),
    )


def random_split(df: DataFrame, keys: Sequence[str], holdout: float = 0.1, seed: int = 42) -> DataFrame:
    """Label a repeatable random share of the rows ``holdout``. It mixes past and future, so
    use ``temporal_split`` to judge forecasts."""
    return df.withColumn("part", F.when(hash_fraction(keys, holdout, seed), "holdout").otherwise("train"))


def split_report(df: DataFrame, date: str) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date")
    )


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in the given columns, or in any."""
    return df.dropna(subset=list(columns) if columns else None)


def fill_within_series(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Fill gaps with the last value before, else the first value of the series, else 0.

    When nothing came before a row, the next value is the first of the whole series, so the
    backward fill needs no frame that grows with the rows still to come.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns(
        {
            c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.first(c, ignorenulls=True).over(whole), F.lit(0.0))
            for c in columns
        }
    )


def panel_frame(
    df: DataFrame,
    keys: Sequence[str],
    date: str,
    target: str,
    history: Sequence[str],
    future: Sequence[str],
    min_length: int = 0,
) -> DataFrame:
    """Model input: ``unique_id, ds, y`` with gap-free history and future covariates.

    ``y`` is clipped at 0 with nulls as 0; history covariates are filled within the series;
    future covariates become integers with nulls as 0; short series are left out.
    """
    if min_length:
        df = long_enough(df, keys, min_length)
    filled = fill_within_series(df, keys, date, available(df, history))
    return filled.select(
        series_id(*keys).alias("unique_id"),
        F.to_date(date).alias("ds"),
        F.coalesce(non_negative(target), F.lit(0.0)).alias("y"),
        *available(df, history),
        *[F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in available(df, future)],
    )


def patch_count(input_size: int, patch_length: int, stride: int) -> int:
    return max(1, (input_size - patch_length) // stride + 1)


def patches(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    input_size: int = 56,
    patch_length: int = 8,
    stride: int = 4,
) -> DataFrame:
    """Cut each series' last ``input_size`` rows into overlapping patches.

    Each row goes to the patches that cover it; a patch then gathers at most
    ``patch_length`` values.
    """
    n = patch_count(input_size, patch_length, stride)
    position = F.lit(input_size) - F.col("age")
    first = F.greatest(F.lit(0), F.ceil((position - patch_length + 1) / stride).cast("int"))
    last = F.least(F.lit(n - 1), F.floor(position / stride).cast("int"))
    placed = (
        tail(df, keys, order, input_size)
        .select(*keys, order, value, position.alias("position"), first.alias("first"), last.alias("last"))
        .filter(F.col("first") <= F.col("last"))
        .withColumn("patch", F.explode(F.sequence("first", "last")))
    )
    ordered = F.array_sort(F.collect_list(F.struct("position", value)))
    return placed.groupBy(*keys, "patch").agg(
        F.min(order).alias("first_step"),
        F.max(order).alias("last_step"),
        F.transform(ordered, lambda s: s[value]).alias("patch_values"),
    )
