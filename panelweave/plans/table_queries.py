"""Queries: sources and sinks, reshaping, joins, samples and set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators import joins, reshape
from panelweave.plans import medallion
from panelweave.plans.registry import query, six
from panelweave.session import fresh_path, measured
from panelweave.sources import layout, retail, tables
from panelweave.sources.retail import IDS, KEYS

SLICE = {"item_id": "PROMO", "store_id": "NATION_3"}
FUTURE = ["day_of_week", "month", "is_weekend", *retail.SNAPS, "event_name_encoded"]
HISTORY = ["sell_price", "lag_7", "lag_28", "roll_mean_7", "roll_mean_28", "roll_std_7"]
MIN_STEPS = retail.HORIZON * 3 + 10


# ---- sources and sinks


@query("src_csv_roundtrip", "SELECT store_id, item_id, wm_yr_wk, sell_price FROM prices", ("prices",))
def src_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly prices through CSV files with a declared schema."""
    path = fresh_path(spark, "prices_csv")
    tables.write_csv(retail.prices(medallion.daily(spark, sf_dir)), path)
    return tables.read_csv(spark, path, retail.PRICES_CSV_SCHEMA)


@query("src_table_roundtrip", "SELECT item_id, store_id, state_id, date, sales, unit_cents, n_lines FROM daily", ("daily",))
def src_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily facts, computed from the raw lines, through a table."""
    path = fresh_path(spark, "daily_table")
    tables.write_table(retail.daily_sales(spark, sf_dir), path)
    return tables.read_table(spark, path)


PANEL_SQL = "SELECT item_id, dept_id, cat_id, store_id, state_id, d, date, sales FROM panel"


@query("sink_partitioned_roundtrip", f"SELECT * FROM ({PANEL_SQL}) WHERE dept_id = 'SIZE_1'", ("panel",))
def sink_partitioned_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel written by department; one department is read back by partition pruning."""
    path = fresh_path(spark, "panel_by_dept")
    tables.write_table(medallion.silver(spark, sf_dir).select(*IDS, "d", "date", "sales"), path, ["dept_id"])
    return tables.read_table(spark, path).filter(F.col("dept_id") == "SIZE_1").select(*IDS, "d", "date", "sales")


@query("sink_clustered_roundtrip", PANEL_SQL, ("panel",))
def sink_clustered_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel clustered by series and day."""
    path = fresh_path(spark, "panel_clustered")
    panel = medallion.silver(spark, sf_dir).select(*IDS, "d", "date", "sales")
    tables.write_clustered(panel, path, [*KEYS, "date"])
    return tables.read_table(spark, path)


ZORDER = ["item_id", "store_id", "date"]


def zordered(spark: SparkSession, sf_dir: str, row_group_bytes: int | None = None) -> str:
    path = fresh_path(spark, "panel_zordered")
    panel = medallion.silver(spark, sf_dir).select(*IDS, "d", "date", "sales")
    layout.write_zordered(panel, path, ZORDER, row_group_bytes=row_group_bytes)
    return path


@query("sink_zordered_roundtrip", PANEL_SQL, ("panel",))
def sink_zordered_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel in Z-order of product, store and day."""
    return tables.read_table(spark, zordered(spark, sf_dir))


@query(
    "layout_skipping",
    """SELECT probe, n_rows, true AS zorder_skips, probe <> 'date' AS sorted_skips FROM (
         SELECT 'item_id' AS probe, count(*) AS n_rows FROM panel WHERE item_id = (SELECT max(item_id) FROM panel)
         UNION ALL SELECT 'store_id', count(*) FROM panel WHERE store_id = (SELECT max(store_id) FROM panel)
         UNION ALL SELECT 'date', count(*) FROM panel WHERE date = (SELECT max(date) - 400 FROM panel))""",
    ("panel",),
)
def layout_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one product, one store and one day, found in the Z-ordered files, and whether the row
    groups that may hold them are fewer than half, there and in files sorted by series and day."""
    panel = medallion.silver(spark, sf_dir).select(*IDS, "d", "date", "sales")
    by_series = fresh_path(spark, "panel_sorted")
    small = 1 << 17  # a table of this size has few row groups otherwise
    ordered = panel.repartitionByRange(*ZORDER).sortWithinPartitions(*ZORDER)
    ordered.write.option("parquet.block.size", small).parquet(by_series)
    z = zordered(spark, sf_dir, small)
    found = tables.read_table(spark, z)
    groups = {"zorder": layout.row_groups(spark, z, ZORDER), "sorted": layout.row_groups(spark, by_series, ZORDER)}
    wanted = {"item_id": F.max("item_id"), "store_id": F.max("store_id"), "date": F.date_sub(F.max("date"), 400)}
    out = None
    for c, pick in wanted.items():
        value = measured(panel.agg(pick.alias(c))).scalar()
        row = found.filter(F.col(c) == value).agg(F.lit(c).alias("probe"), F.count(F.lit(1)).alias("n_rows"))
        for name, table in groups.items():
            few = layout.groups_read(table, c, value).select((F.col("groups_read") * 2 < F.col("n_groups")).alias("few"))
            row = row.withColumn(f"{name}_skips", measured(few).scalar())
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "split_tables",
    """SELECT split, cat_id, count(*) AS n_rows, sum(sales) AS total_sales, min(date) AS first_date, max(date) AS last_date
       FROM splits GROUP BY 1, 2""",
    ("splits",),
)
def split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table per split, written and read back; each reader names only its split."""
    gold = medallion.gold(spark, sf_dir).select("split", "cat_id", "date", "sales")
    root = fresh_path(spark, "splits")
    tables.write_table(gold, root, ["split"])
    parts = [
        tables.read_table(spark, f"{root}/split={name}").withColumn("split", F.lit(name)) for name in ("train", "val", "test")
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("split", "cat_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("sales").alias("total_sales"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


@query("lines_covered", "SELECT CAST(count(*) AS BIGINT) AS n_lines, sum(l_quantity) AS units FROM lineitem")
def lines_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the order lines is in the daily facts: all."""
    return medallion.daily(spark, sf_dir).agg(F.sum("n_lines").alias("n_lines"), F.sum("sales").alias("units"))


@query(
    "table_shapes",
    """SELECT 'daily' AS table_name, count(*) AS n_rows, CAST(7 AS INTEGER) AS n_columns FROM daily
       UNION ALL SELECT 'prices', count(*), 4 FROM prices
       UNION ALL SELECT 'calendar', count(*), 12 FROM calendar
       UNION ALL SELECT 'silver', count(*), 19 FROM silver""",
    ("silver",),
)
def table_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = medallion.daily(spark, sf_dir)
    named = {
        "daily": facts,
        "prices": retail.prices(facts),
        "calendar": retail.calendar(spark, *retail.panel_days(facts)),
        "silver": medallion.silver(spark, sf_dir),
    }
    shapes = [tables.table_shape(df, name) for name, df in named.items()]
    return shapes[0].unionByName(shapes[1]).unionByName(shapes[2]).unionByName(shapes[3])


# ---- reshaping and selection

def wide_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days of the panel, one column per day, written as a table as they would arrive."""
    silver = medallion.silver(spark, sf_dir)
    first, last = retail.panel_days(medallion.daily(spark, sf_dir))
    path = fresh_path(spark, "wide")
    tables.write_table(reshape.pivot_days(silver, IDS, [f"d_{i + 1}" for i in range((last - first).days + 1)]), path)
    return tables.read_table(spark, path)


@query(
    "unpivot_sales",
    "SELECT item_id, dept_id, cat_id, store_id, state_id, d, sales FROM panel",
    ("panel",),
)
def unpivot_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.unpivot_days(wide_sales(spark, sf_dir), IDS)


@query("densify_panel", "SELECT item_id, dept_id, cat_id, store_id, state_id, date, sales FROM panel", ("panel",))
def densify_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medallion.dense_sales(medallion.daily(spark, sf_dir)).select(*IDS, "date", "sales")


@query("select_available", "SELECT item_id, store_id, date, sell_price, snap_A, snap_B, snap_C FROM silver", ("silver",))
def select_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted columns that the table has, and all benefit flags."""
    silver = medallion.silver(spark, sf_dir)
    wanted = ["item_id", "store_id", "date", "sell_price"]
    return silver.select(*reshape.available(silver, wanted), *reshape.columns_with_prefix(silver, "snap_"))


@query(
    "series_slice",
    "SELECT date, sales FROM panel WHERE item_id = 'PROMO' AND store_id = 'NATION_3'",
    ("panel",),
)
def series_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.series_slice(medallion.silver(spark, sf_dir), **SLICE).select("date", "sales").orderBy("date")


@query(
    "semi_filter_series",
    """SELECT item_id, store_id, date, sales FROM panel SEMI JOIN
       (SELECT item_id, store_id FROM daily GROUP BY 1, 2 HAVING sum(sales) > (SELECT sum(sales) / count(DISTINCT (item_id, store_id)) FROM daily)) b
       USING (item_id, store_id)""",
    ("panel", "daily"),
)
def semi_filter_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days of the series that sell more than the average series."""
    totals = medallion.daily(spark, sf_dir).groupBy(*KEYS).agg(F.sum("sales").alias("total"))
    average = totals.agg(F.sum("total") / F.count(F.lit(1))).scalar()
    big = totals.filter(F.col("total") > average)
    panel = medallion.silver(spark, sf_dir).select(*KEYS, "date", "sales")
    return reshape.keep_series(panel, big, KEYS)


@query("series_count", "SELECT count(*) AS n_series FROM (SELECT DISTINCT item_id, store_id FROM daily)", ("daily",))
def series_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.distinct_series(medallion.silver(spark, sf_dir), KEYS).agg(F.count(F.lit(1)).alias("n_series"))


HASH_SQL = "CAST('0x' || substr(md5(concat_ws('|', '42', {keys})), 1, 8) AS BIGINT)"


@query(
    "sample_rows",
    f"""SELECT item_id, store_id, date, sales FROM panel
        WHERE {HASH_SQL.format(keys="item_id, store_id, CAST(date AS VARCHAR)")} % 1000000 < 10000""",
    ("panel",),
)
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one percent row sample."""
    panel = medallion.silver(spark, sf_dir).select(*KEYS, "date", "sales")
    return reshape.sample_rows(panel, [*KEYS, "date"], 0.01)


@query(
    "sample_series",
    f"""SELECT item_id, store_id, date, sales FROM panel SEMI JOIN (
          SELECT item_id, store_id FROM series WHERE {HASH_SQL.format(keys="item_id, store_id")} % 1000000 < 100000
          ORDER BY {HASH_SQL.format(keys="item_id, store_id")}, item_id, store_id LIMIT 10) b USING (item_id, store_id)""",
    ("panel", "series"),
)
def sample_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 10 series out of a ten percent sample of the ids, with all their days."""
    panel = medallion.silver(spark, sf_dir).select(*KEYS, "date", "sales")
    return reshape.sample_series(panel, KEYS, 0.1, 10)


@query(
    "random_split",
    f"""SELECT CASE WHEN {HASH_SQL.format(keys="item_id, store_id, CAST(date AS VARCHAR)")} % 1000000 < 100000
                    THEN 'holdout' ELSE 'train' END AS part, count(*) AS n_rows, sum(sales) AS total_sales
        FROM splits WHERE split = 'train' GROUP BY 1""",
    ("splits",),
)
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = medallion.gold(spark, sf_dir).filter(F.col("split") == "train")
    return (
        reshape.random_split(train.select(*KEYS, "date", "sales"), [*KEYS, "date"])
        .groupBy("part")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("sales").alias("total_sales"))
    )


@query(
    "split_report",
    """SELECT split, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM splits GROUP BY split""",
    ("splits",),
)
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.split_report(medallion.gold(spark, sf_dir), "date")


@query(
    "filter_short_series",
    """SELECT item_id, store_id, date, sales FROM daily SEMI JOIN
       (SELECT item_id, store_id FROM daily GROUP BY 1, 2 HAVING count(*) >= 94) b USING (item_id, store_id)""",
    ("daily",),
)
def filter_short_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with sales, of the series that have enough of them for a model."""
    facts = medallion.daily(spark, sf_dir).select(*KEYS, "date", "sales")
    return reshape.long_enough(facts, KEYS, MIN_STEPS)


@query(
    "val_size",
    """SELECT min(n_days) AS val_size FROM (SELECT item_id, store_id, count(DISTINCT date) AS n_days
       FROM splits WHERE split = 'val' GROUP BY 1, 2)""",
    ("splits",),
)
def val_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    val = medallion.gold(spark, sf_dir).filter(F.col("split") == "val")
    days = val.groupBy(*KEYS).agg(F.count_distinct("date").alias("n_days"))
    return days.agg(F.min("n_days").alias("val_size"))


@query("last_dates", "SELECT item_id, store_id, max(date) AS last_date FROM daily GROUP BY 1, 2", ("daily",))
def last_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last day with a sale, per series."""
    return medallion.daily(spark, sf_dir).groupBy(*KEYS).agg(F.max("date").alias("last_date"))


@query(
    "tail_n",
    """SELECT item_id, store_id, date, sales, CAST(row_number() OVER w AS INTEGER) AS age FROM daily
       WINDOW w AS (PARTITION BY item_id, store_id ORDER BY date DESC) QUALIFY age <= 56""",
    ("daily",),
)
def tail_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 56 days with sales of each series."""
    return reshape.tail(medallion.daily(spark, sf_dir).select(*KEYS, "date", "sales"), KEYS, "date", 56)


@query(
    "patch_frame",
    """SELECT item_id, store_id, CAST(patch AS INTEGER) AS patch, min(date) AS first_step, max(date) AS last_step,
              string_agg(CAST(CAST(sales AS INTEGER) AS VARCHAR), ',' ORDER BY date) AS patch_values
       FROM (SELECT item_id, store_id, date, sales, 56 - row_number() OVER w AS position FROM silver
             WHERE date > DATE '2001-06-03' - 56 AND date <= DATE '2001-06-03'
             WINDOW w AS (PARTITION BY item_id, store_id ORDER BY date DESC)) JOIN range(0, 13) AS p(patch)
       ON position >= patch * 4 AND position < patch * 4 + 8 GROUP BY 1, 2, 3""",
    ("silver",),
)
def patch_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 56 training days of each series in patches of 8 days, 4 apart."""
    train = medallion.gold(spark, sf_dir).filter(F.col("split") == "train").select(*KEYS, "date", "sales")
    cut = reshape.patches(train, KEYS, "date", "sales")
    as_text = F.array_join(F.transform("patch_values", lambda v: v.cast("int").cast("string")), ",")
    return cut.withColumn("patch_values", as_text)


@query(
    "ffill_bfill",
    """SELECT item_id, store_id, date, coalesce(last_value(sell_price IGNORE NULLS) OVER b, first_value(sell_price IGNORE NULLS) OVER a, 0.0) AS sell_price
       FROM silver WINDOW b AS (PARTITION BY item_id, store_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       a AS (PARTITION BY item_id, store_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    ("silver",),
)
def ffill_bfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    silver = medallion.silver(spark, sf_dir).select(*KEYS, "date", "sell_price")
    return reshape.fill_within_series(silver, KEYS, "date", ["sell_price"])


FILLED = ", ".join(
    f"coalesce(last_value({c} IGNORE NULLS) OVER b, first_value({c} IGNORE NULLS) OVER a, 0.0) AS {c}" for c in HISTORY
)


@query(
    "panel_frame",
    f"""SELECT item_id || '_' || store_id AS unique_id, date AS ds, greatest(0.0, sales) AS y, {FILLED},
               day_of_week, month, is_weekend, snap_A, snap_B, snap_C, event_name_encoded
        FROM gold WHERE split IN ('train', 'val')
        WINDOW b AS (PARTITION BY item_id, store_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               a AS (PARTITION BY item_id, store_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    ("gold",),
    six("roll_mean_7", "roll_mean_28", "roll_std_7"),
)
def panel_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model input from the train and validation days."""
    gold = medallion.gold(spark, sf_dir).filter(F.col("split").isin("train", "val"))
    return reshape.panel_frame(gold, KEYS, "date", "sales", HISTORY, FUTURE, MIN_STEPS)


# ---- joins

CALENDAR = "wm_yr_wk, weekday, wday, month, year, event_name_1, event_type_1, snap_A, snap_B, snap_C"


@query(
    "join_calendar",
    f"SELECT p.item_id, p.dept_id, p.cat_id, p.store_id, p.state_id, d, c.date, p.sales, {CALENDAR} FROM panel p JOIN calendar c USING (d)",
    ("panel", "calendar"),
)
def join_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = medallion.daily(spark, sf_dir)
    return joins.join_calendar(medallion.long_sales(facts), retail.calendar(spark, *retail.panel_days(facts)))


@query("join_prices", "SELECT store_id, item_id, wm_yr_wk, date, sales, sell_price FROM silver", ("silver",))
def join_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = medallion.daily(spark, sf_dir)
    sales = medallion.silver(spark, sf_dir).select(*KEYS, "wm_yr_wk", "date", "sales")
    return joins.join_prices(sales, retail.prices(facts))


@query("silver_table", "SELECT * FROM silver", ("silver",))
def silver_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched panel, computed again from the daily facts."""
    return medallion.silver_plan(spark, sf_dir)


# ---- set operations


@query(
    "union_splits",
    "SELECT item_id, store_id, date, sales, split FROM splits WHERE split IN ('train', 'val')",
    ("splits",),
)
def union_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = medallion.gold(spark, sf_dir).select(*KEYS, "date", "sales", "split")
    return gold.filter(F.col("split") == "train").unionByName(gold.filter(F.col("split") == "val"))


@query(
    "common_series",
    """SELECT item_id, store_id FROM daily WHERE date <= DATE '2001-06-03'
       INTERSECT SELECT item_id, store_id FROM daily WHERE date > DATE '2001-06-03' AND date <= DATE '2001-07-01'
       INTERSECT SELECT item_id, store_id FROM daily WHERE date > DATE '2001-07-01' AND date <= DATE '2001-07-29'""",
    ("daily",),
)
def common_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series that sold something in each of the three periods."""
    facts = medallion.daily(spark, sf_dir)
    labelled = reshape.temporal_split(facts, "date", retail.TRAIN_END, retail.VAL_END, retail.TEST_END)
    return reshape.common_series([labelled.filter(F.col("split") == s) for s in ("train", "val", "test")], KEYS)


@query(
    "missing_future",
    """SELECT s.item_id, s.store_id, c.date AS ds FROM series s CROSS JOIN calendar c WHERE c.date > DATE '2001-07-01' AND c.date <= DATE '2001-07-29'
       EXCEPT SELECT item_id, store_id, date FROM daily""",
    ("series", "calendar", "daily"),
)
def missing_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test days that a series should have and the sparse facts do not supply."""
    facts = medallion.daily(spark, sf_dir)
    expected = medallion.silver(spark, sf_dir).filter((F.col("date") > F.lit(retail.VAL_END)) & (F.col("date") <= F.lit(retail.TEST_END)))
    return joins.missing_rows(
        expected.withColumnRenamed("date", "ds"), facts.withColumnRenamed("date", "ds"), [*KEYS, "ds"]
    )
