"""Feature attribution: additive contributions, rankings, dependence and permutation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.columns import EPSILON, hash_order
from panelweave.operators.evaluate import rmse
from panelweave.operators.ranges import with_next
from panelweave.session import written


def linear_score(weights: dict[str, float], intercept: float) -> Column:
    """A linear formula over feature columns, missing values read as 0."""
    score = F.lit(float(intercept))
    for feature, w in weights.items():
        score = score + w * F.coalesce(F.col(feature), F.lit(0.0))
    return score


def linear_contributions(df: DataFrame, keys: Sequence[str], weights: dict[str, float], intercept: float) -> DataFrame:
    """Exact Shapley values of a linear model: ``weight * (x - mean x)`` per feature, as
    ``contrib_<feature>``, with the mean prediction as ``base_value``; their sum is the
    ``prediction``. The means are one aggregate row, read once as a struct."""
    x = {f: F.coalesce(F.col(f), F.lit(0.0)) for f in weights}
    means = df.agg(F.struct(*[F.avg(c).alias(f) for f, c in x.items()]).alias("m"))
    given = df.select(*keys, *[x[f].alias(f) for f in weights]).withColumn("_mean", means.scalar())
    base = F.lit(float(intercept))
    for f, w in weights.items():
        base = base + w * F.col("_mean")[f]
    return given.select(
        *keys,
        *weights,
        base.alias("base_value"),
        *[(w * (F.col(f) - F.col("_mean")[f])).alias(f"contrib_{f}") for f, w in weights.items()],
        linear_score(weights, intercept).alias("prediction"),
    )


def global_ranking(contributions: DataFrame, features: Sequence[str], top: int) -> DataFrame:
    """Features by mean absolute contribution, highest first; one pass over the rows."""
    sizes = contributions.agg(*[F.avg(F.abs(f"contrib_{f}")).alias(f) for f in features])
    long = sizes.unpivot([], list(features), "feature", "mean_abs_contribution")
    return long.orderBy(F.desc("mean_abs_contribution"), "feature").limit(top)


def dependence(contributions: DataFrame, feature: str, width: float, second: str | None = None) -> DataFrame:
    """Mean contribution by bin of the feature (bins of equal ``width``), with the mean of a
    second feature to colour by."""
    bin_start = F.floor(F.col(feature) / width) * F.lit(float(width))
    sums = [F.avg(f"contrib_{feature}").alias("mean_contribution"), F.count(F.lit(1)).alias("n_rows")]
    if second:
        sums.append(F.avg(second).alias(f"mean_{second}"))
    return contributions.groupBy(bin_start.alias("bin_start")).agg(*sums).orderBy("bin_start")


def normalise_importance(table: DataFrame, weight: str) -> DataFrame:
    """Weights as shares of their sum, flagged above the even share and above the median.
    ``table`` has one row per feature."""
    total = table.agg(F.sum(weight).alias("s"), F.count(F.lit(1)).alias("n"), F.median(weight).alias("m"))
    share = F.col(weight) / (total.select("s").scalar() + EPSILON)
    return table.select(
        "feature",
        weight,
        share.alias("share"),
        (share > 1 / total.select("n").scalar()).alias("above_even_share"),
        (F.col(weight) > total.select("m").scalar()).alias("above_median"),
    )


def permuted(df: DataFrame, keys: Sequence[str], features: Sequence[str], seed: int = 42) -> DataFrame:
    """The rows with ``_permuted``, a struct of the features of another row.

    Rows stand in hash order of their keys and take the values of the next one, the last row those
    of the first: one random cycle through all rows, the same for any number of partitions. Rows
    with equal keys go on by their values.
    """
    ordered = df.withColumn("_order", hash_order(keys, seed))
    return with_next(ordered, ["_order", *keys, *features], features, "_permuted").drop("_order")


def permutation_importance(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    target: str,
    scorer: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Rise in rmse when a feature's values are exchanged between rows. ``scorer`` adds
    ``yhat``. Rows are ordered once; then there is one scan per feature, which yields one row."""
    rows = written(permuted(df, keys, features), "permuted")
    base = scorer(rows.drop("_permuted")).agg(rmse(target).alias("rmse"))
    out = None
    for f in features:
        exchanged = rows.withColumn(f, F.col("_permuted")[f]).drop("_permuted")
        row = scorer(exchanged).agg(rmse(target).alias("permuted_rmse")).select(F.lit(f).alias("feature"), "permuted_rmse")
        out = row if out is None else out.unionByName(row)
    return out.select("feature", "permuted_rmse", (F.col("permuted_rmse") - base.scalar()).alias("importance"))
