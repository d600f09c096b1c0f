"""Exact additive contributions of boosted trees, in one Arrow pass over the rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.session import fresh_path


@dataclass(frozen=True)
class Leaf:
    value: float
    steps: tuple[tuple[int, bool], ...]  # node, and whether its left side leads here


@dataclass(frozen=True)
class Tree:
    weight: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    rows: np.ndarray  # training rows that reached the node

    def leaves(self) -> list[Leaf]:
        out, todo = [], [(0, ())]
        while todo:
            node, steps = todo.pop()
            if self.left[node] < 0:
                out.append(Leaf(self.value[node] * self.weight, steps))
            else:
                todo += [(self.left[node], (*steps, (node, True))), (self.right[node], (*steps, (node, False)))]
        return out


def node_table(spark: SparkSession, model: GBTRegressionModel) -> DataFrame:
    """Nodes of a fitted model as rows, from its saved form."""
    path = fresh_path(spark, "trees")
    model.write().save(path)
    node = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "_about", "weight").drop("_about")
    return node.join(weights, "treeID").select(
        "treeID", "id", "prediction", F.col("impurityStats")[0].alias("n_rows"), "leftChild", "rightChild",
        F.col("split.featureIndex").alias("feature"), F.col("split.numCategories").alias("categories"),
        F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"), "weight",
    )


def trees_of(spark: SparkSession, model: GBTRegressionModel) -> list[Tree]:
    """The trees as arrays. Their size is that of the model (rounds by nodes), not of the data."""
    rows = node_table(spark, model).orderBy("treeID", "id").toPandas()
    if (rows["categories"] >= 0).any():
        raise ValueError("categorical splits have no order that a threshold could stand for")
    return [
        Tree(float(t["weight"].iloc[0]), *[t[c].to_numpy() for c in ("feature", "threshold", "leftChild", "rightChild", "prediction", "n_rows")])
        for _, t in rows.groupby("treeID")
    ]


@dataclass(frozen=True)
class Share:
    """What one leaf gives to its features: a row of ``parts`` for each set of them that a row meets."""

    features: tuple[int, ...]
    steps: tuple[tuple[tuple[int, bool], ...], ...]  # per feature
    parts: np.ndarray


def share(tree: Tree, leaf: Leaf) -> tuple[float, Share]:
    """Shapley values of a leaf, for all 2^k ways a row can meet its k features.

    With a set S of features known, the leaf counts with the value times the product over its
    features of ``met`` (1 or 0) for those in S and of the share of training rows that go the
    leaf's way for the others. Sums over sets of equal size are coefficients of a polynomial.
    """
    by_feature: dict[int, list] = {}
    passed: dict[int, float] = {}
    for node, is_left in leaf.steps:
        f = int(tree.feature[node])
        child = tree.left[node] if is_left else tree.right[node]
        by_feature.setdefault(f, []).append((node, is_left))
        passed[f] = passed.get(f, 1.0) * tree.rows[child] / tree.rows[node]
    names, k = tuple(by_feature), len(by_feature)
    z = np.array([passed[f] for f in names])
    met = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1
    parts = np.zeros((1 << k, k))
    for i in range(k):
        sums = np.ones((1 << k, 1))
        for j in range(k):
            if j != i:
                sums = np.pad(sums * z[j], ((0, 0), (0, 1))) + np.pad(sums * met[:, j : j + 1], ((0, 0), (1, 0)))
        weight = np.array([math.factorial(s) * math.factorial(k - 1 - s) / math.factorial(k) for s in range(k)])
        parts[:, i] = leaf.value * (met[:, i] - z[i]) * (sums @ weight)
    return leaf.value * float(np.prod(z)), Share(names, tuple(tuple(by_feature[f]) for f in names), parts)


def explained(x: np.ndarray, trees: Sequence[Tree], shares: Sequence[Sequence[Share]]) -> np.ndarray:
    """Contribution of each feature to each row."""
    out = np.zeros(x.shape)
    for tree, leaves in zip(trees, shares):
        inner = np.flatnonzero(tree.left >= 0)
        with np.errstate(invalid="ignore"):
            goes_left = {n: x[:, tree.feature[n]] <= tree.threshold[n] for n in inner}  # a missing value goes right
        for s in leaves:
            met = np.zeros(len(x), np.int64)
            for i, steps in enumerate(s.steps):
                meets = np.ones(len(x), bool)
                for node, is_left in steps:
                    meets &= goes_left[node] if is_left else ~goes_left[node]
                met |= meets.astype(np.int64) << i
            if s.features:
                out[:, s.features] += s.parts[met]
    return out


def tree_contributions(df: DataFrame, keys: Sequence[str], features: Sequence[str], trees: Sequence[Tree]) -> DataFrame:
    """Shapley values of each row's prediction, as ``contrib_<feature>`` beside ``base_value`` (what
    the trees give when no feature is known, by the training rows that went each way) and
    ``prediction``, which is their sum and not clipped. A missing value goes right, as in scoring.

    The columns are those of ``linear_contributions``, so rankings and dependence tables read
    both. A feature no tree splits on gets 0. Work per row is that of visiting all leaves.
    """
    names = list(features)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = [[share(t, leaf) for leaf in t.leaves()] for t in trees]
        base = sum(b for leaves in told for b, _ in leaves)
        shares = [[s for _, s in leaves] for leaves in told]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = np.column_stack([part.column(f).to_numpy(zero_copy_only=False).astype(float) for f in names]) if part.num_rows else np.zeros((0, len(names)))
                given = explained(x, trees, shares)
                columns = [part.column(c) for c in [*keys, *names]]
                columns += [pa.array(np.full(len(x), base)), *[pa.array(given[:, i]) for i in range(len(names))], pa.array(base + given.sum(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, [*keys, *names, "base_value", *[f"contrib_{f}" for f in names], "prediction"])

    rows = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in names])
    added = ", ".join(f"`{c}` double" for c in ["base_value", *[f"contrib_{f}" for f in names], "prediction"])
    own = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(explain, f"{own}, {added}")
