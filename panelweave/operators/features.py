"""Features of a panel: lags, rolling statistics, calendar, price and group z-scores.

Window functions of one series share a single partitioning and order, so all lags and
rolling columns come from one sorted pass. A series has one row per day, which bounds it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import EPSILON, calendar_parts
from panelweave.session import fits_broadcast, measured

# Default lags, rolling windows and rolling statistics.
LAGS = (1, 7, 14, 28)
WINDOWS = (7, 14, 28)
STATISTICS = ("mean", "std", "min", "max")

# What each rolling statistic needs to know of a block of rows.
BLOCK_PARTS = {"mean": ("sum",), "std": ("sum", "squares"), "min": ("min",), "max": ("max",)}


def add_lags(df: DataFrame, keys: Sequence[str], order: str, value: str, lags: Sequence[int] = LAGS) -> DataFrame:
    """``lag_k``: the value k rows earlier in the series; a day lag on a dense panel."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in lags})


def add_rolling(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    windows: Sequence[int] = WINDOWS,
    statistics: Sequence[str] = STATISTICS,
    full_window: bool = False,
) -> DataFrame:
    """``roll_<statistic>_<w>`` over the ``w`` rows before the current one.

    By default a shorter history still gives a value; with ``full_window`` it gives null.

    Spark evaluates a sliding frame row by row, so its cost is the sum of the window sizes.
    Here only one block, as long as the windows' common divisor, is a sliding frame; a longer
    window merges the block with the blocks 1, 2, ... block lengths earlier in the series.
    Windows without a common divisor fall back to blocks of one row, which is still right.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    block = math.gcd(*windows)
    frame = w.rowsBetween(-block, -1)
    v = F.col(value)
    # Counts, sums and squared deviations of an empty block are 0, its extremes null.
    parts = {
        "n": F.count(v).over(frame),
        "sum": F.coalesce(F.sum(v).over(frame).cast("double"), F.lit(0.0)),
        "squares": F.coalesce(F.var_pop(v).over(frame) * F.count(v).over(frame), F.lit(0.0)),
        "min": F.min(v).over(frame),
        "max": F.max(v).over(frame),
    }
    empty = {"n": 0, "sum": 0.0, "squares": 0.0, "min": None, "max": None}
    needed = {"n", *chain.from_iterable(BLOCK_PARTS[s] for s in statistics)}
    names = [p for p in parts if p in needed]
    reach = max(windows) // block
    blocks = df.withColumns({f"_{p}_0": parts[p] for p in names})
    blocks = blocks.withColumns(
        {f"_{p}_{i}": F.lag(f"_{p}_0", i * block, empty[p]).over(w) for i in range(1, reach) for p in names}
    )
    out = {}
    for size in windows:
        merged = _merge_blocks(size // block, statistics)
        for name in statistics:
            c = merged[name]
            out[f"roll_{name}_{size}"] = F.when(_total("n", size // block) == size, c) if full_window else c
    return blocks.withColumns(out).drop(*[f"_{p}_{i}" for p in names for i in range(reach)])


def _total(part: str, blocks: int) -> Column:
    return reduce(Column.__add__, [F.col(f"_{part}_{i}") for i in range(blocks)])


def _merge_blocks(blocks: int, statistics: Sequence[str]) -> dict[str, Column]:
    """Statistics of several blocks from their counts, sums, squared deviations and ranges."""
    n = _total("n", blocks)
    out = {}
    if "mean" in statistics or "std" in statistics:
        out["mean"] = mean = F.when(n > 0, _total("sum", blocks) / n)
    if "std" in statistics:
        squares = _total("squares", blocks)
        for i in range(blocks if blocks > 1 else 0):
            off = F.col(f"_sum_{i}") / F.greatest(F.col(f"_n_{i}"), F.lit(1)) - mean
            squares = squares + F.col(f"_n_{i}") * off * off
        out["std"] = F.when(n > 1, F.sqrt(squares / (n - 1)))
    for name, pick in (("min", F.least), ("max", F.greatest)):
        if name in statistics:
            columns = [F.col(f"_{name}_{i}") for i in range(blocks)]
            out[name] = pick(*columns) if blocks > 1 else columns[0]
    return out


def add_calendar(df: DataFrame, date: str) -> DataFrame:
    return df.withColumns(calendar_parts(date))


def add_price(df: DataFrame, keys: Sequence[str], order: str, price: str = "sell_price") -> DataFrame:
    """Price of the row before, and the absolute and relative change since then."""
    w = Window.partitionBy(*keys).orderBy(order)
    return (
        df.withColumn("price_lag_1", F.lag(price).over(w))
        .withColumn("price_change", F.col(price) - F.col("price_lag_1"))
        .withColumn("price_pct_change", F.col("price_change") / (F.col("price_lag_1") + EPSILON))
    )


def add_group_zscore(df: DataFrame, by: Sequence[str], value: str, name: str, series: Sequence[str] = ()) -> DataFrame:
    """``(value - group mean) / (group std + 1e-8)``; exactly 0 in a group of equal values,
    whose mean is taken as that value so that rounding is not blown up by the small divisor.

    Group statistics are combined map-side and joined back. A window over the group would
    bring all its rows, possibly a third of the table, into one task. Where the statistics are
    too large to broadcast and the table is bucketed by ``series``, they go to the distinct pairs
    of series and group first, and those, a row per series and group, to the rows where they
    lie: the table itself is not moved.
    """
    low, high = F.min(value), F.max(value)
    mean = F.when(low == high, low).otherwise(F.avg(value))
    std = F.when(F.stddev_samp(value).isNotNull() & (low == high), 0.0).otherwise(F.stddev_samp(value))
    stats = measured(df.groupBy(*by).agg(mean.alias("_mean"), std.alias("_std")))
    on = list(by)
    if series and not fits_broadcast(stats):
        on = [*series, *[c for c in by if c not in series]]
        stats = df.select(*on).distinct().join(stats, list(by))
    return (
        df.join(stats, on, "left")
        .withColumn(name, (F.col(value) - F.col("_mean")) / (F.col("_std") + EPSILON))
        .drop("_mean", "_std")
    )
