"""Global models over all series: distributed boosted trees and linear regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.columns import non_negative
from panelweave.operators.boosting import ROUNDS, TreeParams, assembler, boost


def fit_trees(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    is_validation: Column,
    rounds: int = ROUNDS,
    depth: int = TreeParams.depth,
    seed: int = 42,
) -> PipelineModel:
    """Boosted trees on complete rows, cut at the best round of ``boosting.boost``."""
    return boost(train, features, target, is_validation, rounds, params=TreeParams(depth=depth), seed=seed).model


def predict(model: PipelineModel, rows: DataFrame, output: str = "yhat") -> DataFrame:
    """Score all rows and clip at 0. Trees send a missing value to the right of a split; a
    linear model, which has no other rule for it, reads it as 0."""
    if isinstance(model.stages[-1], LinearRegressionModel):
        own = {c: rows[c] for c in model.stages[0].getInputCols()}
        filled = model.transform(rows.withColumns({f"_own_{c}": v for c, v in own.items()}).fillna(0.0, subset=list(own)))
        scored = filled.withColumns({c: F.col(f"_own_{c}") for c in own}).drop(*[f"_own_{c}" for c in own])
    else:
        scored = model.transform(rows)
    return scored.withColumn(output, non_negative("prediction")).drop("features", "prediction")


def importances(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Feature importances as rows, highest first. The vector of a cut model ends with the last feature
    that a tree asks for; those behind it have none."""
    found = model.stages[-1].featureImportances.toArray()
    weights = [*found, *[0.0] * (len(features) - len(found))]
    table = SparkSession.active().createDataFrame([(f, float(w)) for f, w in zip(features, weights)], "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature")


def fit_linear(train: DataFrame, features: Sequence[str], target: str) -> PipelineModel:
    rows = train.select(*features, F.col(target).cast("double").alias("label")).dropna()
    return Pipeline(stages=[assembler(features), LinearRegression()]).fit(rows)


def linear_weights(model: PipelineModel, features: Sequence[str]) -> tuple[dict[str, float], float]:
    """Coefficients by feature, and the intercept."""
    line = model.stages[-1]
    return {f: float(c) for f, c in zip(features, line.coefficients)}, float(line.intercept)
