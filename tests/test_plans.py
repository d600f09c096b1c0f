"""What the plans must look like: which rows move, and what reaches the scan."""

from __future__ import annotations

import re

from compare import operators, plan
from pyspark.sql import functions as F

from panelweave.operators import features, joins
from panelweave.plans import feature_queries, forecast_queries, medallion, table_queries
from panelweave.session import measured, shared_folder
from panelweave.sources import retail, tables
from panelweave.sources.retail import KEYS


def test_series_windows_do_not_shuffle(spark, sf_dir):
    ops = operators(medallion.window_features(medallion.silver(spark, sf_dir)))
    assert "Window" in ops and "Exchange" not in ops and ops.count("Sort") == 1


def test_silver_moves_no_rows(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        ops = operators(medallion.silver_plan(spark, sf_dir))
        assert "Exchange" not in ops and "Generate" in ops
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_staged_tables_have_one_file_per_bucket(spark, sf_dir):
    n = tables.bucket_count(spark)
    assert len(medallion.silver(spark, sf_dir).inputFiles()) <= n
    assert len(medallion.gold(spark, sf_dir).filter("split = 'val'").inputFiles()) <= 3 * n


def test_rewritten_sources_give_new_stages(spark, sf_dir, tmp_path):
    for name in retail.FACT_TABLES:
        retail.raw(spark, sf_dir, name).write.parquet(f"{tmp_path}/{name}.parquet")
    before = medallion.daily(spark, str(tmp_path))
    assert medallion.daily(spark, str(tmp_path)).inputFiles() == before.inputFiles()
    n_before, key = before.agg(F.sum("sales")).first()[0], retail.source_key(spark, str(tmp_path))
    lines = retail.raw(spark, sf_dir, "lineitem")
    lines.write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    assert retail.source_key(spark, str(tmp_path)) != key
    assert medallion.daily(spark, str(tmp_path)).agg(F.sum("sales")).first()[0] == 2 * n_before


def test_gold_moves_only_small_tables(spark, sf_dir):
    ops = operators(medallion.gold_plan(medallion.silver(spark, sf_dir)))
    assert "Exchange" not in ops and "SortMergeJoin" not in ops and ops.count("BroadcastHashJoin") == 6


def test_large_encodings_are_not_broadcast(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        ops = operators(medallion.gold_plan(medallion.silver(spark, sf_dir)))
        assert "BroadcastHashJoin" not in ops and "SortMergeJoin" in ops
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_zscore_does_not_move_the_panel_when_its_statistics_are_large(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        silver = medallion.silver(spark, sf_dir).select(*KEYS, "date", "wm_yr_wk", "sell_price")
        text = plan(features.add_group_zscore(silver, ["store_id", "wm_yr_wk"], "sell_price", "z", KEYS))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", text)
    assert moved and not any("date#" in columns for columns in moved)
    assert "SortMergeJoin" in text


def test_price_join_moves_no_sales_rows(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sales = medallion.silver(spark, sf_dir).select(*KEYS, "wm_yr_wk", "date", "sales")
        prices = retail.prices(medallion.daily(spark, sf_dir))
        assert "Exchange" not in operators(joins.join_prices(sales, prices))
        # Prices of unknown layout: they move to where the sales are.
        assert operators(joins.join_prices(sales, prices.repartition(3))).count("Exchange") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_grouped_map_runs_in_place(spark, sf_dir):
    ops = operators(forecast_queries.forecast_seasonal_reg(spark, sf_dir))
    assert "FlatMapGroupsInPandas" in ops and "Exchange" not in ops


def test_a_split_reads_only_its_files_and_columns(spark, sf_dir):
    text = plan(forecast_queries.train(spark, sf_dir, 28).select(*KEYS, "sales"))
    assert "split" in re.search(r"PartitionFilters: (.*)", text)[1]
    assert "GreaterThan(date" in re.search(r"PushedFilters: (.*)", text)[1]
    assert re.search(r"ReadSchema: (.*)", text)[1].count(":") == 4


def test_raw_lines_are_read_by_column_and_none_is_dropped(spark, sf_dir):
    daily = retail.daily_sales(spark, sf_dir)
    assert daily.agg(F.sum("n_lines")).first()[0] == retail.raw(spark, sf_dir, "lineitem").count()
    text = plan(daily)
    assert "l_tax" not in text and "l_discount" not in text


def test_unpivot_is_narrow(spark, sf_dir):
    wide = table_queries.wide_sales(spark, sf_dir)
    assert operators(wide).count("Exchange") == operators(table_queries.unpivot_sales(spark, sf_dir)).count("Exchange")


def test_group_statistics_come_without_a_group_window(spark, sf_dir):
    assert "Window" not in operators(feature_queries.price_norm(spark, sf_dir))


def test_small_tables_live_in_the_shared_folder(spark):
    df = measured(spark.range(5).select(F.col("id").alias("x")))
    assert shared_folder(spark) in df.inputFiles()[0] and df.count() == 5


def test_bucket_count_follows_the_setting_and_not_the_cores(spark):
    assert tables.bucket_count(spark) == 8
    spark.conf.set("spark.sql.shuffle.partitions", "100000")
    try:
        assert tables.bucket_count(spark) == 100_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_rolling_sorts_once(spark, sf_dir):
    b = medallion.silver(spark, sf_dir).select(*KEYS, "date", "sales")
    ops = operators(features.add_rolling(features.add_lags(b, KEYS, "date", "sales"), KEYS, "date", "sales"))
    assert ops.count("Sort") == 1
