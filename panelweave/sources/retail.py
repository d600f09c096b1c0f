"""Adapter: an order-line star schema as a retail panel.

Items are part types, stores are the supplier's nations, states its regions. The panel
runs from the first to the last day of the facts; a calendar and a weekly price table go
with it.
"""

from __future__ import annotations

import datetime as dt
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.columns import iso_week_key
from panelweave.sources.tables import content_key

KEYS = ["item_id", "store_id"]
IDS = ["item_id", "dept_id", "cat_id", "store_id", "state_id"]
SNAPS = ["snap_A", "snap_B", "snap_C"]

# The last day of each split. Later days belong to the panel and to no split.
TRAIN_END = dt.date(2001, 6, 3)
VAL_END = dt.date(2001, 7, 1)
TEST_END = dt.date(2001, 7, 29)
HORIZON = 28

# Category and department of each part type.
CATEGORY_OF_TYPE = {
    "SMALL": "SIZE",
    "MEDIUM": "SIZE",
    "LARGE": "SIZE",
    "ECONOMY": "LINE",
    "STANDARD": "LINE",
    "PROMO": "LINE",
}
DEPARTMENT_OF_TYPE = {
    "SMALL": "SIZE_1",
    "MEDIUM": "SIZE_1",
    "LARGE": "SIZE_2",
    "ECONOMY": "LINE_1",
    "STANDARD": "LINE_1",
    "PROMO": "LINE_2",
}

# Yearly events by month and day, and the days of month of each benefit flag.
EVENTS = {"01-01": ("NewYear", "National"), "07-04": ("Independence", "National"), "12-25": ("Christmas", "Religious")}
SNAP_DAYS = {"snap_A": (1, 10), "snap_B": (6, 15), "snap_C": (11, 20)}

SALES_CSV_SCHEMA = "item_id string, dept_id string, cat_id string, store_id string, state_id string, d string, sales double"
CALENDAR_CSV_SCHEMA = (
    "d string, date date, wm_yr_wk int, weekday string, wday int, month int, year int, "
    "event_name_1 string, event_type_1 string, snap_A int, snap_B int, snap_C int"
)
PRICES_CSV_SCHEMA = "store_id string, item_id string, wm_yr_wk int, sell_price double"


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


FACT_TABLES = ("lineitem", "part", "supplier", "nation", "region")


def source_key(spark: SparkSession, sf_dir: str) -> str:
    """Tells the states of the tables that the panel is made from apart."""
    return content_key(spark, *[f"{sf_dir}/{table}.parquet" for table in FACT_TABLES])


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a log of runs: a run per event, named by kind and user, started at its
    time; errors are failed runs."""
    millis = F.timestamp_diff("MILLISECOND", F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return raw(spark, sf_dir, "events").select(
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("run_id"),
        F.concat_ws("_", "event_type", F.col("user_id").cast("string")).alias("run_name"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("FINISHED").alias("status"),
        millis.alias("start_millis"),
    )


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])[key]


def with_hierarchy(df: DataFrame) -> DataFrame:
    """Add department and category, both decided by the type that an item id starts with. A type
    without a fixed place is its own department in the category OTHER."""
    kind = F.split("item_id", "_")[0]
    return df.withColumns(
        {
            "dept_id": F.coalesce(_lookup(DEPARTMENT_OF_TYPE, kind), kind),
            "cat_id": F.coalesce(_lookup(CATEGORY_OF_TYPE, kind), F.lit("OTHER")),
        }
    )


def daily_sales(spark: SparkSession, sf_dir: str, by_brand: bool = False) -> DataFrame:
    """Units, unit prices in whole cents and line count by item, store and day of sale.

    One pass over all order lines, of which the needed columns are read; the sums are combined
    before the shuffle, so a heavy item or store costs its days, not its lines.
    """
    lines = raw(spark, sf_dir, "lineitem").select(
        "l_partkey",
        "l_suppkey",
        F.col("l_shipdate").alias("shipped"),
        F.col("l_quantity").alias("units"),
        F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("bigint").alias("unit_cents"),
    )
    item = F.concat_ws("_", "p_type", "p_brand") if by_brand else F.col("p_type")
    parts = raw(spark, sf_dir, "part").select("p_partkey", item.alias("item_id"))
    stores = (
        raw(spark, sf_dir, "supplier")
        .join(raw(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(raw(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.col("n_name").alias("store_id"), F.col("r_name").alias("state_id"))
    )
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(stores, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("item_id", "store_id", "state_id", F.col("shipped").cast("date").alias("date"))
        .agg(
            F.sum("units").alias("sales"),
            F.sum("unit_cents").alias("unit_cents"),
            F.count(F.lit(1)).alias("n_lines"),
        )
    )


def prices(daily: DataFrame) -> DataFrame:
    """Mean unit price of each item, store and week with a sale, in whole cents."""
    return (
        daily.groupBy("store_id", "item_id", iso_week_key("date").alias("wm_yr_wk"))
        .agg((F.round(F.sum("unit_cents") / F.sum("n_lines")) / 100).alias("sell_price"))
    )


def panel_days(daily: DataFrame) -> tuple[dt.date, dt.date]:
    """First and last day of the facts: one aggregate, two dates. One day if there are none."""
    first, last = daily.agg(F.min("date"), F.max("date")).first()
    return (first, last) if first else (TRAIN_END, TRAIN_END)


def calendar(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """One row per day."""
    month_day = F.date_format("date", "MM-dd")
    name = _lookup({k: v[0] for k, v in EVENTS.items()}, month_day)
    kind = _lookup({k: v[1] for k, v in EVENTS.items()}, month_day)
    return (
        spark.range(0, (end - start).days + 1, numPartitions=1)
        .select((F.col("id") + 1).alias("n"), F.date_add(F.lit(start), F.col("id").cast("int")).alias("date"))
        .select(
            day_label(F.col("n")).alias("d"),
            "date",
            iso_week_key("date").alias("wm_yr_wk"),
            F.date_format("date", "EEEE").alias("weekday"),
            F.dayofweek("date").alias("wday"),
            F.month("date").alias("month"),
            F.year("date").alias("year"),
            name.alias("event_name_1"),
            kind.alias("event_type_1"),
            *[F.dayofmonth("date").between(a, b).cast("int").alias(s) for s, (a, b) in SNAP_DAYS.items()],
        )
    )


def day_label(n: Column) -> Column:
    return F.concat(F.lit("d_"), n.cast("string"))


def day_label_of(date: Column | str, start: dt.date) -> Column:
    return day_label(F.datediff(date, F.lit(start)) + 1)


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second panel: summed event value and number of events by event type and hour. The
    hour is built from its parts, so the session time zone plays no role."""
    ts, zero = F.col("ts"), F.lit(0)
    hour = F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), zero, zero.cast("decimal(16,6)"))
    return (
        raw(spark, sf_dir, "events")
        .groupBy("event_type", hour.alias("hour"))
        .agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n_events"))
    )
