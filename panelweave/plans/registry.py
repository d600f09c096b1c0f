"""Register of the queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.plans.oracle import with_ctes
from panelweave.session import configure

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Plan
    sql: str | None


QUERIES: dict[str, Query] = {}


def round_columns(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round doubles, so that the order of summation does not show. Adding 0 turns -0 to 0."""
    return df.withColumns({c: F.round(c, n) + F.lit(0.0) for c, n in digits.items()}) if digits else df


def _rounded_sql(sql: str, digits: dict[str, int]) -> str:
    if not digits:
        return sql
    replaced = ", ".join(f"round({c}, {n}) + 0.0 AS {c}" for c, n in digits.items())
    return f"SELECT * REPLACE ({replaced}) FROM ({sql})"


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = (), digits: dict[str, int] | None = None) -> Callable[[Plan], Plan]:
    """Register a plan. ``sql`` may use the named common tables; ``digits`` gives the places
    that both results are rounded to."""
    digits = digits or {}

    def register(plan: Plan) -> Plan:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_columns(plan(configure(spark), sf_dir), digits)

        run.__name__ = name
        QUERIES[name] = Query(run, with_ctes(ctes, _rounded_sql(sql, digits)) if sql else None)
        return plan

    return register


def six(*columns: str) -> dict[str, int]:
    return dict.fromkeys(columns, 6)
