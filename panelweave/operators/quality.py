"""Data quality gate over the full table.

All column checks are sums in one aggregate pass; a uniqueness check adds one grouped count.
Nulls are left to the not-null check: range and set checks ignore them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT_COLUMNS = ["check_no", "expectation", "column_name", "element_count", "unexpected_count", "observed_mean", "success"]


@dataclass(frozen=True)
class Expectation:
    """One check; ``kind`` is not_null, between, mean_between, in_set, unique or columns."""

    kind: str
    columns: tuple[str, ...]
    low: Any = None
    high: Any = None
    allowed: tuple = field(default=())


def not_null(column: str) -> Expectation:
    return Expectation("not_null", (column,))


def between(column: str, low: Any, high: Any) -> Expectation:
    return Expectation("between", (column,), low, high)


def mean_between(column: str, low: float, high: float) -> Expectation:
    return Expectation("mean_between", (column,), low, high)


def in_set(column: str, allowed: Sequence[Any]) -> Expectation:
    return Expectation("in_set", (column,), allowed=tuple(allowed))


def unique(*columns: str) -> Expectation:
    return Expectation("unique", columns)


def columns_match(*columns: str) -> Expectation:
    return Expectation("columns", columns)


def _violations(e: Expectation) -> Column:
    c = F.col(e.columns[0])
    if e.kind == "not_null":
        bad = c.isNull()
    elif e.kind == "between":
        bad = ~c.between(F.lit(e.low), F.lit(e.high))
    elif e.kind == "in_set":
        bad = ~c.isin(*e.allowed)
    else:
        bad = F.lit(False)
    return F.count_if(bad)


def _result(no: int, e: Expectation, elements: Column, unexpected: Column, mean: Column, success: Column) -> Column:
    return F.struct(
        F.lit(no).alias("check_no"),
        F.lit(e.kind).alias("expectation"),
        F.lit(",".join(e.columns)).alias("column_name"),
        elements.cast("bigint").alias("element_count"),
        unexpected.cast("bigint").alias("unexpected_count"),
        mean.cast("double").alias("observed_mean"),
        success.alias("success"),
    )


def _column_checks(df: DataFrame, checks: list[tuple[int, Expectation]]) -> DataFrame:
    sums = {"_rows": F.count(F.lit(1))}
    for no, e in checks:
        sums[f"_bad_{no}"] = _violations(e)
        if e.kind == "mean_between":
            sums[f"_mean_{no}"] = F.avg(e.columns[0])
    results = []
    for no, e in checks:
        bad = F.col(f"_bad_{no}")
        if e.kind == "mean_between":
            mean = F.col(f"_mean_{no}")
            success = F.coalesce(mean.between(e.low, e.high), F.lit(False))
        elif e.kind == "columns":
            mean, success = F.lit(None), F.lit(tuple(df.columns) == e.columns)
        else:
            mean, success = F.lit(None), bad == 0
        results.append(_result(no, e, F.col("_rows"), bad, mean, success))
    return df.agg(*[c.alias(name) for name, c in sums.items()]).select(F.inline(F.array(*results)))


def _unique_check(df: DataFrame, no: int, e: Expectation) -> DataFrame:
    per_key = df.groupBy(*e.columns).agg(F.count(F.lit(1)).alias("_n"))
    totals = per_key.agg(
        F.sum("_n").alias("_rows"), F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("_bad")
    )
    row = _result(no, e, F.col("_rows"), F.col("_bad"), F.lit(None), F.col("_bad") == 0)
    return totals.select(F.inline(F.array(row)))


def check(df: DataFrame, expectations: Sequence[Expectation]) -> DataFrame:
    """One result row per expectation, numbered in the given order."""
    numbered = list(enumerate(expectations, start=1))
    parts = [_unique_check(df, no, e) for no, e in numbered if e.kind == "unique"]
    column_checks = [(no, e) for no, e in numbered if e.kind != "unique"]
    if column_checks:
        parts.insert(0, _column_checks(df, column_checks))
    return reduce(DataFrame.unionByName, parts).select(*RESULT_COLUMNS)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def failures(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("success"))


def summary(results: DataFrame) -> DataFrame:
    """Evaluated, successful and failed checks, success percentage and overall result."""
    passed = F.count_if(F.col("success"))
    evaluated = F.count(F.lit(1))
    return results.agg(
        evaluated.alias("evaluated"),
        passed.alias("successful"),
        (evaluated - passed).alias("failed"),
        (passed / evaluated * 100).alias("success_percent"),
        (passed == evaluated).alias("overall_success"),
    )


class QualityGateError(ValueError):
    """At least one expectation was not met."""

    def __init__(self, failed: list[str]):
        super().__init__(f"{len(failed)} checks failed: {', '.join(failed)}")
        self.n_failed = len(failed)


def gate(results: DataFrame) -> None:
    """Raise when a check failed. ``results`` has one row per check."""
    failed = [f"{r['expectation']}({r['column_name']})" for r in failures(results).collect()]
    if failed:
        raise QualityGateError(failed)
