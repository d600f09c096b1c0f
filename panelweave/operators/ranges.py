"""Global orders without one task that sees all rows: ranges, and one small row per range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.session import measured, written

PART, AT = "_part", "_at"


def in_ranges(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Rows dealt by ranges of the order and sorted inside them, written so that they stay so.
    ``_part`` numbers the ranges and ``_at`` the rows, both in the order. Only rows that are equal in
    the whole order must share a range, so end the order with a key."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(sorted_rows.withColumn(AT, F.monotonically_increasing_id()), "ranges")
    return placed.withColumn(PART, F.shiftright(AT, 33))


def running_sum(df: DataFrame, order: Sequence[Column | str], weight: str, name: str) -> DataFrame:
    """Add the sum of ``weight`` over all rows before, in the global order."""
    placed = in_ranges(df, order)
    totals = placed.groupBy(PART).agg(F.sum(weight).alias("_total"))
    before = measured(totals.select(PART, (F.sum("_total").over(Window.orderBy(PART)) - F.col("_total")).alias("_before")))  # a row per range
    inside = F.sum(weight).over(Window.partitionBy(PART).orderBy(AT)) - F.col(weight)
    return placed.join(before, PART).withColumn(name, F.col("_before") + inside).drop(PART, AT, "_before")


def with_next(df: DataFrame, order: Sequence[Column | str], columns: Sequence[str], name: str) -> DataFrame:
    """Add the ``columns`` of the next row in the global order as a struct; the last row gets those
    of the first one. The last row of a range takes the first row of the next, of which there is
    one per range."""
    placed = in_ranges(df, order)
    own = F.struct(*columns)
    firsts = placed.groupBy(PART).agg(F.min_by(own, AT).alias("_first"))
    ordered = Window.orderBy(PART)  # a row per range
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = measured(firsts.select(PART, F.coalesce(F.lead("_first").over(ordered), F.first("_first").over(whole)).alias("_edge")))
    following = F.lead(own).over(Window.partitionBy(PART).orderBy(AT))
    return placed.join(edges, PART).withColumn(name, F.coalesce(following, F.col("_edge"))).drop(PART, AT, "_edge")


def quantiles(df: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, as one row ``q0, q1, ...``; nulls do not count.

    Values are counted, the counts are summed up over ranges of the values, and the rows that hold
    the wanted ranks are picked: no task and no buffer holds all distinct values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    summed = running_sum(counts, ["v"], "c", "before")
    total = measured(summed.agg(F.sum("c").alias("n")))
    at = {s: (F.col("n") - 1) * F.lit(float(s)) for s in shares}

    def ranked(rank: Column) -> Column:
        rank = rank.cast("bigint")
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("c")), F.col("v")))

    picks = [pick for i, s in enumerate(shares) for pick in (ranked(F.floor(at[s])).alias(f"low{i}"), ranked(F.ceil(at[s])).alias(f"high{i}"))]
    found = summed.withColumn("n", total.scalar()).agg(*picks, F.max("n").alias("n"))
    share = {i: at[s] - F.floor(at[s]) for i, s in enumerate(shares)}
    return found.select(*[(F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * share[i]).alias(f"q{i}") for i in range(len(shares))])
