"""Encodings: fitted as small tables, applied by join. Fit on training rows only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.session import measured


@dataclass(frozen=True)
class TargetEncoding:
    """Group means of the target, one table per column, and the mean for unseen groups."""

    means: dict[str, DataFrame]
    default: float | None


def fit_target_encoding(train: DataFrame, columns: Sequence[str], target: str, weight: float = 0.0) -> TargetEncoding:
    """Mean target per value of each column, pulled to the global mean by ``weight`` rows.

    One pass sums the training rows by all columns together; the grouping sets then run over
    those few sums, so no row is expanded.
    """
    level = F.grouping_id()
    sets = [[c] for c in columns] + [[]]
    together = train.groupBy(*columns).agg(F.sum(target).alias("_sum"), F.count(target).alias("_n"))
    totals = measured(
        together.groupingSets(sets, *columns).agg(level.alias("_level"), F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    )
    # One row: the empty grouping set.
    whole = totals.filter(F.col("_level") == 2 ** len(columns) - 1).select("_sum", "_n").first()
    default = whole["_sum"] / whole["_n"] if whole and whole["_n"] else None
    means = {}
    for i, c in enumerate(columns):
        bits = 2 ** len(columns) - 1 - 2 ** (len(columns) - 1 - i)
        mean = F.col("_sum") / F.col("_n")
        if weight:
            mean = (F.col("_n") * mean + weight * F.lit(default)) / (F.col("_n") + weight)
        means[c] = totals.filter((F.col("_level") == bits) & F.col(c).isNotNull()).select(c, mean.alias(f"te_{c}"))
    return TargetEncoding(means, default)


def apply_target_encoding(df: DataFrame, encoding: TargetEncoding) -> DataFrame:
    """Add ``te_<column>`` for each fitted column; unseen values get the global mean."""
    for c, means in encoding.means.items():
        df = df.join(means, c, "left")
    return df.fillna({f"te_{c}": encoding.default for c in encoding.means}) if encoding.default is not None else df


def fit_event_codes(df: DataFrame, label: str, order: str = "frequency") -> DataFrame:
    """Codes 0, 1, ... of the distinct labels, by falling frequency (ties alphabetical) or
    alphabetically. The ranking runs over the distinct labels, not over the rows."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    ranking = [F.col("_n").desc(), F.col(label)] if order == "frequency" else [F.col(label)]
    code = F.row_number().over(Window.orderBy(*ranking)) - 1
    return measured(counts.select(label, code.alias("_code")))


def apply_event_codes(df: DataFrame, codes: DataFrame, label: str, output: str, missing: int | None = None) -> DataFrame:
    """Add the code of each label. Nulls and unknown labels get ``missing``, by default the
    code after the last one."""
    absent = codes.count() if missing is None else missing
    return (
        df.join(codes, label, "left")
        .withColumn(output, F.coalesce("_code", F.lit(absent)).cast("int"))
        .drop("_code")
    )
