"""Model runs as a table of metrics, and the rankings made from it.

A run table has one row per run and metric: ``run_id, run_name, status, start_millis,
metric, value``. It grows with the number of runs, not with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.columns import EPSILON, epoch_millis_minute

# Names under which a run may have logged each metric, first match wins.
METRIC_NAMES = {
    "rmsse": ("val_rmsse", "test_rmsse", "rmsse"),
    "rmse": ("val_rmse", "test_rmse", "rmse"),
    "mae": ("val_mae", "test_mae", "mae"),
    "smape": ("val_smape", "test_smape", "smape_pct", "smape"),
}


def leaderboard(runs: DataFrame) -> DataFrame:
    """One row per finished run that has an rmse, best first: by rmsse when any run has one,
    else by rmse, runs without it last, ties by name."""
    pick = {
        m: F.round(F.coalesce(*[F.max(F.when(F.col("metric") == n, F.col("value"))) for n in names]), 4)
        for m, names in METRIC_NAMES.items()
    }
    board = (
        runs.filter(F.col("status") == "FINISHED")
        .groupBy("run_id", "run_name", "start_millis")
        .agg(*[c.alias(m) for m, c in pick.items()])
        .filter(F.col("rmse").isNotNull())
    )
    any_rmsse = board.agg(F.count("rmsse").alias("n")).scalar() > 0
    rank_by = F.when(any_rmsse, F.col("rmsse")).otherwise(F.col("rmse"))
    return (
        board.withColumn("_rank_by", rank_by)
        .orderBy(F.col("_rank_by").asc_nulls_last(), "run_name", "run_id")
        .select(
            "run_name",
            F.substring("run_id", 1, 8).alias("run_id"),
            *METRIC_NAMES,
            epoch_millis_minute("start_millis").alias("start_time"),
            F.split(F.lower("run_name"), "_")[0].alias("model_family"),
        )
    )


def best_model(board: DataFrame) -> DataFrame:
    """First row of a leaderboard; its order is restated, since row order is not kept."""
    any_rmsse = board.agg(F.count("rmsse").alias("n")).scalar() > 0
    rank_by = F.when(any_rmsse, F.col("rmsse")).otherwise(F.col("rmse"))
    return board.orderBy(rank_by.asc_nulls_last(), "run_name").limit(1)


def latest_run(runs: DataFrame, pattern: str) -> DataFrame:
    """Newest run whose name matches a LIKE pattern, a row however many metrics it logged; of runs
    that began together, all."""
    names = runs.filter(F.col("run_name").like(pattern)).select("run_id", "run_name", "status", "start_millis")
    newest = names.agg(F.max("start_millis")).scalar()
    return names.filter(F.col("start_millis") == newest).distinct()


def normalised(board: DataFrame, metrics: Sequence[str] = tuple(METRIC_NAMES)) -> DataFrame:
    """``1 - value / (max + 1e-8)`` per metric over the runs that have all of them; empty
    when fewer than two do."""
    complete = board.select("run_name", *metrics).dropna()
    top = complete.agg(F.count(F.lit(1)).alias("n"), *[F.max(m).alias(m) for m in metrics])
    enough = top.select("n").scalar() >= 2
    return complete.filter(enough).select(
        "run_name",
        *[(1 - F.col(m) / (top.select(m).scalar() + EPSILON)).alias(f"{m}_norm") for m in metrics],
    )


def metrics_to_runs(metrics: DataFrame, run_id: str, run_name: str, start_millis: int, names: dict[str, str], status: str = "FINISHED") -> DataFrame:
    """A one-row metrics table as run rows; ``names`` maps its columns to logged names."""
    return metrics.select(
        F.lit(run_id).alias("run_id"),
        F.lit(run_name).alias("run_name"),
        F.lit(status).alias("status"),
        F.lit(start_millis).cast("bigint").alias("start_millis"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(logged).alias("metric"), F.col(c).cast("double").alias("value"))
                    for c, logged in names.items()
                ]
            )
        ),
    )


def run_benchmark(
    spark: SparkSession,
    forecasters: dict[str, Callable[[], DataFrame]],
    score: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Run and score each named forecaster; an error becomes a row and the others go on.

    A forecaster is a Spark job and ``score`` returns one row, which is all that reaches the
    driver per model.
    """
    rows = []
    for name, forecast in forecasters.items():
        try:
            rows.append(score(forecast()).first().asDict() | {"model": name, "status": "ok", "error": None})
        except Exception as error:
            rows.append({"model": name, "status": "failed", "error": str(error).splitlines()[0]})
    metrics = sorted({k for r in rows for k in r} - {"model", "status", "error"})
    schema = "model string, status string, error string" + "".join(f", {m} double" for m in metrics)
    as_row = lambda r: (r["model"], r["status"], r["error"], *[None if r.get(m) is None else float(r[m]) for m in metrics])
    return spark.createDataFrame([as_row(r) for r in rows], schema)


def union_runs(runs: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, runs)
