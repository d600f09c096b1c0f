"""The staged tables: daily facts, silver (enriched panel) and gold (features by split).

Each is written once per application and state of its source files below the shared folder,
bucketed by series, so that later plans start from files rather than from a long lineage. Only the sparse daily facts
are shuffled to their buckets; silver and gold rows are made, and written, in place.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators import encodings, features, joins, reshape
from panelweave.session import configure
from panelweave.sources import retail
from panelweave.sources.retail import IDS, KEYS
from panelweave.sources.tables import save_series_table

EVENT = "event_name_1"
ENCODED = ["dept_id", "cat_id", "store_id", "state_id"]
ROLL_COLUMNS = [f"roll_{s}_{w}" for w in features.WINDOWS for s in features.STATISTICS]
LAG_COLUMNS = [f"lag_{k}" for k in features.LAGS]


def _staged(
    spark: SparkSession,
    sf_dir: str,
    stage: str,
    by_brand: bool,
    build: Callable[[], DataFrame],
    partition_by: tuple[str, ...] = (),
    placed: bool = True,
) -> DataFrame:
    configure(spark)
    source = retail.source_key(spark, sf_dir) + ("_brand" if by_brand else "")
    name = f"panelweave_{stage}_{source}_{re.sub(r'[^0-9a-zA-Z]', '_', spark.sparkContext.applicationId)}"
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return save_series_table(build(), name, KEYS, "date", partition_by, placed=placed)


def daily(spark: SparkSession, sf_dir: str, by_brand: bool = False) -> DataFrame:
    build = lambda: retail.daily_sales(spark, sf_dir, by_brand)
    return _staged(spark, sf_dir, "daily", by_brand, build, placed=False)


def series(daily_facts: DataFrame) -> DataFrame:
    return retail.with_hierarchy(reshape.describe_series(daily_facts, KEYS, ["state_id"])).select(*IDS)


def dense_sales(daily_facts: DataFrame) -> DataFrame:
    """Sales of every series on every panel day."""
    return reshape.densify(daily_facts, series(daily_facts), KEYS, "date", *retail.panel_days(daily_facts), {"sales": 0.0})


def long_sales(daily_facts: DataFrame) -> DataFrame:
    """Dense sales labelled by day, as an unpivoted wide table would give them."""
    first, _ = retail.panel_days(daily_facts)
    return dense_sales(daily_facts).select(*IDS, retail.day_label_of("date", first).alias("d"), "sales")


def build_silver(sales: DataFrame, calendar: DataFrame, prices: DataFrame) -> DataFrame:
    """Long sales with the day's attributes and the week's price."""
    enriched = joins.join_prices(joins.join_calendar(sales, calendar), prices)
    return enriched.select(
        *IDS, "d", "date", F.col("sales").cast("double").alias("sales"), *[c for c in calendar.columns if c not in ("d", "date")], "sell_price"
    )


def silver_plan(spark: SparkSession, sf_dir: str, by_brand: bool = False) -> DataFrame:
    facts = daily(spark, sf_dir, by_brand)
    return build_silver(long_sales(facts), retail.calendar(spark, *retail.panel_days(facts)), retail.prices(facts))


def silver(spark: SparkSession, sf_dir: str, by_brand: bool = False) -> DataFrame:
    return _staged(spark, sf_dir, "silver", by_brand, lambda: silver_plan(spark, sf_dir, by_brand))


def window_features(df: DataFrame) -> DataFrame:
    """Lags, rolling statistics and price changes: one partitioning, one sort."""
    df = features.add_lags(df, KEYS, "date", "sales")
    df = features.add_rolling(df, KEYS, "date", "sales")
    return features.add_price(df, KEYS, "date")


def gold_plan(silver_table: DataFrame) -> DataFrame:
    """Silver plus all features, rows with a full lag history, labelled by split.

    The small tables are joined first, while rows are narrow; the windows then widen them.
    """
    train = silver_table.filter(F.col("date") <= F.lit(retail.TRAIN_END))
    means = encodings.fit_target_encoding(train, ENCODED, "sales")
    codes = encodings.fit_event_codes(silver_table, EVENT)
    df = features.add_group_zscore(silver_table, ["store_id", "wm_yr_wk"], "sell_price", "price_norm_store", KEYS)
    df = encodings.apply_target_encoding(df, means)
    df = encodings.apply_event_codes(df, codes, EVENT, "event_name_encoded")
    df = features.add_calendar(window_features(df), "date")
    df = reshape.drop_incomplete(df, [f"lag_{max(features.LAGS)}"])
    return reshape.temporal_split(df, "date", retail.TRAIN_END, retail.VAL_END, retail.TEST_END)


def gold(spark: SparkSession, sf_dir: str, by_brand: bool = False) -> DataFrame:
    return _staged(
        spark, sf_dir, "gold", by_brand, lambda: gold_plan(silver(spark, sf_dir, by_brand)), partition_by=("split",)
    )
