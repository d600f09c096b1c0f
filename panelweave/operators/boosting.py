"""Boosted trees with patience, and a seeded search over their parameters."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, fields, replace

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rounds at most, and rounds without a better error before boosting ends.
ROUNDS = 500
PATIENCE = 30


@dataclass(frozen=True)
class TreeParams:
    """The defaults of the model."""

    depth: int = 6
    rate: float = 0.05
    row_share: float = 0.8
    feature_share: float = 0.8
    min_rows: int = 1
    min_gain: float = 0.0

    def regressor(self, rounds: int, seed: int) -> GBTRegressor:
        return GBTRegressor(
            featuresCol="features",
            labelCol="label",
            predictionCol="prediction",
            maxIter=rounds,
            maxDepth=self.depth,
            stepSize=self.rate,
            subsamplingRate=self.row_share,
            featureSubsetStrategy=str(float(self.feature_share)),
            minInstancesPerNode=self.min_rows,
            minInfoGain=self.min_gain,
            seed=seed,
        )


# Ranges that the search draws from, integers even, reals on a log scale.
SEARCH_SPACE = {
    "depth": (3, 10),
    "rate": (0.01, 0.3),
    "row_share": (0.5, 1.0),
    "feature_share": (0.5, 1.0),
    "min_rows": (1, 10),
}


@dataclass(frozen=True)
class Boosted:
    """A model cut at its best round. ``errors`` are the rmse on the held-out rows after each
    round that was tried; ``best`` rounds of them are kept."""

    model: PipelineModel
    errors: tuple[float, ...]
    best: int


def assembler(features: Sequence[str]) -> VectorAssembler:
    """Missing values are kept, so that scoring loses no row; fitting drops them before."""
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def stopped_at(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """The best round up to the first one that is ``patience`` rounds past it, and whether such a
    round was seen. Of equal errors the earlier round counts."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def errors_by_round(model: GBTRegressionModel, held: DataFrame) -> list[float]:
    return [math.sqrt(e) for e in model.evaluateEachIteration(held, "squared")]


def cut(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The first ``rounds`` rounds of a model, as a fit of that many would give them, without a fit."""
    context, ml = SparkSession.active().sparkContext, SparkSession.active()._jvm.org.apache.spark.ml.regression
    fitted, given = model.trees, model.treeWeights
    trees = context._gateway.new_array(ml.DecisionTreeRegressionModel, rounds)
    weights = context._gateway.new_array(context._jvm.double, rounds)
    for i in range(rounds):
        trees[i], weights[i] = fitted[i]._java_obj, given[i]
    kept = ml.GBTRegressionModel(model.uid, trees, weights)
    return GBTRegressionModel(kept).setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


@dataclass(frozen=True)
class Split:
    """Assembled complete rows, those to fit and those that judge; kept for the fits of a search."""

    stages: VectorAssembler
    fit: DataFrame
    held: DataFrame

    def release(self) -> None:
        self.fit.unpersist()
        self.held.unpersist()


def split_rows(train: DataFrame, features: Sequence[str], target: str, is_validation: Column) -> Split:
    rows = train.select(*features, F.col(target).cast("double").alias("label"), is_validation.alias("held_out")).dropna()
    stages = assembler(features)
    ready = stages.transform(rows).select("features", "label", "held_out")
    kept = [ready.filter(c).drop("held_out").persist(StorageLevel.MEMORY_AND_DISK) for c in (~F.col("held_out"), F.col("held_out"))]
    return Split(stages, *kept)


def boost(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    is_validation: Column,
    rounds: int = ROUNDS,
    patience: int = PATIENCE,
    params: TreeParams | None = None,
    seed: int = 42,
) -> Boosted:
    """Boost on complete rows until ``patience`` rounds in a row bring no better error on the rows
    marked ``is_validation`` (the newest days), or ``rounds`` are done; keep the best round.

    Every round's error is measured, so a worse round, which drawn rows and columns make now and
    then, ends nothing. A fit cannot be continued; its first rounds do not depend on how many
    follow (each round has its own seed), so where the rounds tried do not settle it they are
    doubled, and the model that is returned is the last fit cut at the best round. With nothing
    held out all rounds are kept and there are no errors.
    """
    params = params or TreeParams()
    split = split_rows(train, features, target, is_validation)
    try:
        if split.held.isEmpty():
            model = params.regressor(rounds, seed).fit(split.fit)
            return Boosted(PipelineModel([split.stages, model]), (), rounds)
        tried = min(rounds, patience + 5)
        while True:
            model = params.regressor(tried, seed).fit(split.fit)
            errors = errors_by_round(model, split.held)
            best, settled = stopped_at(errors, patience)
            if settled or tried == rounds:
                break
            tried = min(rounds, 2 * tried)
        return Boosted(PipelineModel([split.stages, cut(model, best)]), tuple(errors[: best + patience]), best)
    finally:
        split.release()


def draw(n: int, seed: int, space: dict[str, tuple] = SEARCH_SPACE) -> list[TreeParams]:
    """``n`` parameter sets, the same ones for a seed. Ranges of integers are drawn evenly, others on
    a log scale."""
    rng = random.Random(seed)
    kinds = {f.name: f.type for f in fields(TreeParams)}

    def one(name: str, low, high):
        if kinds[name] == "int":
            return rng.randint(low, high)
        return round(math.exp(rng.uniform(math.log(low), math.log(high))), 6)

    return [replace(TreeParams(), **{k: one(k, *v) for k, v in space.items()}) for _ in range(n)]


def search(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    is_validation: Column,
    candidates: Sequence[TreeParams],
    first_rounds: int = 10,
    keep: int = 3,
    rounds: int = ROUNDS,
    seed: int = 42,
    on_rung: Callable[[int, int], None] | None = None,
) -> DataFrame:
    """Successive halving: all candidates are fitted for a few rounds, the best ``1/keep`` of them for
    ``keep`` times as many, and so on until one is left or ``rounds`` are reached.

    A candidate is judged by its best error on the rows marked ``is_validation``. Returns a row
    per candidate, best first: number, parameters, the rounds it was given, its best round and
    that round's rmse. Those that went further come first, since only they were compared there.
    """
    split = split_rows(train, features, target, is_validation)
    table = {}
    try:
        alive, given = list(range(len(candidates))), min(first_rounds, rounds)
        while alive:
            for c in alive:
                errors = errors_by_round(candidates[c].regressor(given, seed).fit(split.fit), split.held)
                best = min(range(len(errors)), key=errors.__getitem__)
                table[c] = (given, best + 1, errors[best])
            if on_rung:
                on_rung(given, len(alive))
            if len(alive) == 1 or given == rounds:
                break
            alive = sorted(alive, key=lambda c: (table[c][2], c))[: max(1, len(alive) // keep)]
            given = min(rounds, given * keep)
    finally:
        split.release()
    rows = [(c, *asdict(candidates[c]).values(), *table[c]) for c in table]
    named = ", ".join(f"{f.name} {'int' if f.type == 'int' else 'double'}" for f in fields(TreeParams))
    made = train.sparkSession.createDataFrame(rows, f"candidate int, {named}, rounds int, best_round int, validation_rmse double")
    return made.orderBy(F.desc("rounds"), "validation_rmse", "candidate")
