"""What-if analysis: score a table again under changed features, and compare.

A scorer takes a table and adds ``yhat``; it may be a fitted model or a column formula.
Scenarios are a short list on the driver; rows are multiplied by it in a narrow operation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.columns import EPSILON

Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Change:
    """``kind`` is relative (x * (1 + value)), multiply (x * value) or replace (value)."""

    feature: str
    kind: str
    value: float

    def apply(self) -> Column:
        x = F.col(self.feature)
        if self.kind == "relative":
            return x * (1 + self.value)
        if self.kind == "multiply":
            return x * self.value
        if self.kind == "replace":
            return F.lit(self.value)
        raise ValueError(f"unknown change {self.kind!r}")


def interpret(feature: str, value: Any) -> Change:
    """A bare value as a change: a non-zero float above -1 and up to 1 is relative, anything
    else replaces. So 1.0 doubles a feature and the integer 1 sets it to 1."""
    relative = isinstance(value, float) and value != 0 and -1 < value <= 1
    return Change(feature, "relative" if relative else "replace", value)


def changed(df: DataFrame, changes: Sequence[Change]) -> DataFrame:
    """Apply changes to a table; changes to features it lacks are skipped."""
    types = dict(df.dtypes)
    return df.withColumns(
        {c.feature: c.apply().cast("double" if c.kind != "replace" else types[c.feature]) for c in changes if c.feature in types}
    )


def what_if(df: DataFrame, scorer: Scorer, changes: Sequence[Change]) -> DataFrame:
    """Baseline and counterfactual per row, with the absolute and relative impact in percent.

    The table is scored as it is, changed in place and scored again: no shuffle, and the
    rows need no key to meet again. The changed features are returned.
    """
    baseline = scorer(df).withColumnRenamed("yhat", "baseline")
    both = scorer(changed(baseline, changes)).withColumnRenamed("yhat", "counterfactual")
    impact = F.col("counterfactual") - F.col("baseline")
    return both.withColumn("impact_absolute", impact).withColumn(
        "impact_relative_pct", impact / (F.abs("baseline") + EPSILON) * 100
    )


def scenario_rows(df: DataFrame, scenarios: dict[str, Sequence[Change]]) -> DataFrame:
    """Every row once per scenario, with that scenario's changes applied."""
    names = F.explode(F.array(*[F.lit(n) for n in scenarios]))
    rows = df.withColumn("scenario", names)
    types = dict(df.dtypes)
    new = {}
    for name, changes in scenarios.items():
        for c in changes:
            if c.feature in types:
                current = new.get(c.feature, F.col(c.feature))
                new[c.feature] = F.when(F.col("scenario") == name, c.apply()).otherwise(current)
    return rows.withColumns(new)


def compare_scenarios(df: DataFrame, scorer: Scorer, scenarios: dict[str, Sequence[Change]]) -> DataFrame:
    """Mean forecast per named scenario and its difference from the baseline."""
    scored = scorer(scenario_rows(df, {"baseline": [], **scenarios}))
    means = scored.groupBy("scenario").agg(F.avg("yhat").alias("mean_forecast"), F.count(F.lit(1)).alias("n_rows"))
    base = means.filter(F.col("scenario") == "baseline").select("mean_forecast")
    return means.withColumn("delta", F.col("mean_forecast") - base.scalar())


def sweep(df: DataFrame, scorer: Scorer, feature: str, values: Sequence[float]) -> DataFrame:
    """Mean forecast with one feature set to each value in turn, and as it is (value null)."""
    rows = df.withColumn("sweep_value", F.explode(F.array(F.lit(None).cast("double"), *[F.lit(float(v)) for v in values])))
    rows = rows.withColumn(feature, F.coalesce(F.col("sweep_value"), F.col(feature).cast("double")))
    return (
        scorer(rows)
        .groupBy("sweep_value")
        .agg(F.avg("yhat").alias("mean_forecast"))
        .select(
            F.when(F.col("sweep_value").isNull(), "baseline").otherwise(feature).alias("scenario"),
            "sweep_value",
            "mean_forecast",
        )
    )
