"""Queries: exploration, features, encodings and the quality gate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators import encodings, explore, features, quality, reshape
from panelweave.plans import medallion
from panelweave.plans.medallion import ENCODED, EVENT, LAG_COLUMNS, ROLL_COLUMNS
from panelweave.plans.registry import query, six
from panelweave.session import measured
from panelweave.sources import retail
from panelweave.sources.retail import KEYS

# ---- exploration


@query(
    "sales_summary",
    """SELECT count(sales) AS n, avg(sales) AS mean, stddev_samp(sales) AS std, min(sales) AS min,
              quantile_cont(sales, 0.25) AS p25, quantile_cont(sales, 0.5) AS p50, quantile_cont(sales, 0.75) AS p75,
              max(sales) AS max FROM panel""",
    ("panel",),
    six("mean", "std"),
)
def sales_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.distribution(medallion.silver(spark, sf_dir), "sales")


@query(
    "price_summary",
    """SELECT count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, quantile_cont(v, 0.25) AS p25,
              quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, max(v) AS max
       FROM (SELECT l_extendedprice * (1 - l_discount) / l_quantity AS v FROM lineitem)""",
    digits=six("mean", "std", "min", "p25", "p50", "p75", "max"),
)
def price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a real number that hardly ever repeats: the unit price of each order line."""
    lines = retail.raw(spark, sf_dir, "lineitem")
    return explore.distribution(lines.select((F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")).alias("v")), "v")


@query(
    "zero_rate",
    """SELECT cat_id, avg(CAST(sales = 0 AS INTEGER)) AS zero_rate, avg(sales) AS avg_sales,
              stddev_samp(sales) AS std_sales, count(sales) AS n_obs FROM panel GROUP BY cat_id""",
    ("panel",),
    six("zero_rate", "avg_sales", "std_sales"),
)
def zero_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.zero_rate(medallion.silver(spark, sf_dir), ["cat_id"])


@query("daily_total", "SELECT date, sum(sales) AS total_sales FROM panel GROUP BY date", ("panel",))
def daily_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.total_by_date(medallion.silver(spark, sf_dir))


@query(
    "dept_monthly",
    """SELECT dept_id, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
              avg(sales) AS avg_sales, strftime(date_trunc('month', date), '%Y-%m') AS period
       FROM panel GROUP BY dept_id, year(date), month(date), date_trunc('month', date)""",
    ("panel",),
    six("avg_sales"),
)
def dept_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.monthly_mean(medallion.silver(spark, sf_dir), ["dept_id"])


@query(
    "dow_dept",
    "SELECT wday, dept_id, avg(sales) AS avg_sales FROM silver GROUP BY 1, 2",
    ("silver",),
    six("avg_sales"),
)
def dow_dept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.weekday_mean(medallion.silver(spark, sf_dir), ["dept_id"])


@query(
    "price_stats",
    """SELECT dept_id, avg(sell_price) AS avg_price, stddev_samp(sell_price) AS std_price, min(sell_price) AS min_price,
              max(sell_price) AS max_price, count(DISTINCT sell_price) AS n_price_points
       FROM silver WHERE sell_price IS NOT NULL GROUP BY dept_id""",
    ("silver",),
    six("avg_price", "std_price"),
)
def price_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.price_statistics(medallion.silver(spark, sf_dir), ["dept_id"])


CHECKED = [*LAG_COLUMNS, *ROLL_COLUMNS, "day_of_week", "month", "is_weekend", "sell_price", "price_pct_change"]


@query(
    "null_counts",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS n_nulls FROM gold" for c in CHECKED),
    ("gold",),
)
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.null_counts(medallion.gold(spark, sf_dir), CHECKED)


@query(
    "feature_describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std,
                   CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM gold WHERE split = 'train'"""
        for c in CHECKED
    ),
    ("gold",),
    six("mean", "std", "min", "max"),
)
def feature_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = medallion.gold(spark, sf_dir).filter(F.col("split") == "train")
    return explore.describe_features(train, CHECKED)


# ---- window features


def base(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return medallion.silver(spark, sf_dir).select(*KEYS, "date", *columns)


@query(
    "lag_features",
    "SELECT item_id, store_id, date, sales, lag_1, lag_7, lag_14, lag_28 FROM lagged",
    ("lagged",),
)
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_lags(base(spark, sf_dir, "sales"), KEYS, "date", "sales")


@query(
    "rolling_features",
    f"SELECT item_id, store_id, date, sales, {', '.join(ROLL_COLUMNS)} FROM rolled",
    ("rolled",),
    six(*[c for c in ROLL_COLUMNS if "mean" in c or "std" in c]),
)
def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_rolling(base(spark, sf_dir, "sales"), KEYS, "date", "sales")


FULL = [f"roll_{s}_{w}" for w in features.WINDOWS for s in ("mean", "std")]


@query(
    "rolling_full_window",
    "SELECT item_id, store_id, date, sales, "
    + ", ".join(f"CASE WHEN row_number() OVER w > {c.rsplit('_', 1)[1]} THEN {c} END AS {c}" for c in FULL)
    + " FROM rolled WINDOW w AS (PARTITION BY item_id, store_id ORDER BY date)",
    ("rolled",),
    six(*FULL),
)
def rolling_full_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_rolling(
        base(spark, sf_dir, "sales"), KEYS, "date", "sales", statistics=("mean", "std"), full_window=True
    )


@query(
    "calendar_features",
    """SELECT item_id, store_id, date, CAST(dayofweek(date) + 1 AS INTEGER) AS day_of_week,
              CAST(day(date) AS INTEGER) AS day_of_month, CAST(week(date) AS INTEGER) AS week_of_year,
              CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year,
              CAST(quarter(date) AS INTEGER) AS quarter, CAST(dayofweek(date) IN (0, 6) AS INTEGER) AS is_weekend
       FROM panel""",
    ("panel",),
)
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_calendar(base(spark, sf_dir), "date")


@query(
    "price_features",
    """SELECT item_id, store_id, date, sell_price, price_lag_1, price_change, price_pct_change
       FROM silver JOIN priced USING (item_id, store_id, date)""",
    ("silver", "priced"),
    six("price_change", "price_pct_change"),
)
def price_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_price(base(spark, sf_dir, "sell_price"), KEYS, "date")


@query(
    "price_norm",
    """SELECT item_id, store_id, date, wm_yr_wk, sell_price,
              CASE WHEN stddev_samp(sell_price) OVER g IS NULL THEN NULL
                   WHEN min(sell_price) OVER g = max(sell_price) OVER g THEN sell_price * 0
                   ELSE (sell_price - avg(sell_price) OVER g) / (stddev_samp(sell_price) OVER g + 1e-8) END AS price_norm_store
       FROM silver WINDOW g AS (PARTITION BY store_id, wm_yr_wk)""",
    ("silver",),
    six("price_norm_store"),
)
def price_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir, "wm_yr_wk", "sell_price")
    return features.add_group_zscore(df, ["store_id", "wm_yr_wk"], "sell_price", "price_norm_store", KEYS)


# ---- encodings


def train_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("date") <= F.lit(retail.TRAIN_END))


TARGET_SQL = (
    "SELECT item_id, store_id, date, "
    + ", ".join(f"avg(sales) FILTER (date <= DATE '2001-06-03') OVER (PARTITION BY {c}) AS te_{c}" for c in ENCODED)
    + " FROM panel"
)
TARGETS = [f"te_{c}" for c in ENCODED]


@query("target_encoding", TARGET_SQL, ("panel",), six(*TARGETS))
def target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    silver = medallion.silver(spark, sf_dir)
    fitted = encodings.fit_target_encoding(train_rows(silver), ENCODED, "sales")
    keys = list(dict.fromkeys([*KEYS, *ENCODED]))
    return encodings.apply_target_encoding(silver.select(*keys, "date"), fitted).select(*KEYS, "date", *TARGETS)


@query(
    "target_encoding_smooth",
    "WITH g AS (SELECT avg(sales) AS m FROM panel WHERE date <= DATE '2001-06-03') SELECT item_id, store_id, date, "
    + ", ".join(
        f"""(count(sales) FILTER (date <= DATE '2001-06-03') OVER (PARTITION BY {c})
             * avg(sales) FILTER (date <= DATE '2001-06-03') OVER (PARTITION BY {c}) + 1000 * g.m)
            / (count(sales) FILTER (date <= DATE '2001-06-03') OVER (PARTITION BY {c}) + 1000) AS te_{c}"""
        for c in ENCODED
    )
    + " FROM panel, g",
    ("panel",),
    six(*TARGETS),
)
def target_encoding_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    silver = medallion.silver(spark, sf_dir)
    fitted = encodings.fit_target_encoding(train_rows(silver), ENCODED, "sales", weight=1000)
    keys = list(dict.fromkeys([*KEYS, *ENCODED]))
    return encodings.apply_target_encoding(silver.select(*keys, "date"), fitted).select(*KEYS, "date", *TARGETS)


@query(
    "event_encoding",
    """SELECT item_id, store_id, date, s.event_name_1,
              coalesce(code, CAST((SELECT count(*) FROM event_codes) AS INTEGER)) AS event_name_encoded
       FROM silver s LEFT JOIN event_codes e ON e.event_name_1 = s.event_name_1""",
    ("silver", "event_codes"),
)
def event_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir, EVENT)
    return encodings.apply_event_codes(df, encodings.fit_event_codes(df, EVENT), EVENT, "event_name_encoded")


@query(
    "event_encoding_alpha",
    """SELECT item_id, store_id, date, s.event_name_1, coalesce(code, -1) AS event_name_encoded
       FROM silver s LEFT JOIN (SELECT event_name_1, CAST(dense_rank() OVER (ORDER BY event_name_1) - 1 AS INTEGER) AS code
         FROM (SELECT DISTINCT event_name_1 FROM silver WHERE event_name_1 IS NOT NULL)) e ON e.event_name_1 = s.event_name_1""",
    ("silver",),
)
def event_encoding_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir, EVENT)
    codes = encodings.fit_event_codes(df, EVENT, order="alphabetical")
    return encodings.apply_event_codes(df, codes, EVENT, "event_name_encoded", missing=-1)


# ---- the full feature table

GOLD_REALS = [
    *[c for c in ROLL_COLUMNS if "mean" in c or "std" in c],
    "price_change",
    "price_pct_change",
    "price_norm_store",
    *TARGETS,
]


@query("gold_features", "SELECT * FROM gold", ("gold",), six(*GOLD_REALS))
def gold_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features, computed again from the silver table."""
    return medallion.gold_plan(medallion.silver(spark, sf_dir))


@query(
    "features_clean",
    f"""SELECT item_id, store_id, date, sales, {', '.join(LAG_COLUMNS)}, sell_price, price_pct_change
        FROM gold WHERE sell_price IS NOT NULL AND price_pct_change IS NOT NULL""",
    ("gold",),
    six("price_pct_change"),
)
def features_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows complete in every model feature."""
    columns = [*KEYS, "date", "sales", *LAG_COLUMNS, "sell_price", "price_pct_change"]
    return reshape.drop_incomplete(medallion.gold(spark, sf_dir).select(*columns))


# ---- quality gate

# Bounds of the quality gate.
SALES_RANGE = (0.0, 1000.0)
MEAN_RANGE = (1.0, 30.0)
ROLLING_RANGE = (0.0, 500.0)
PRICE_RANGE = (0.01, 200.0)

STATES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
CATEGORIES = ("SIZE", "LINE")

SCHEMA = [
    "item_id",
    "dept_id",
    "cat_id",
    "store_id",
    "state_id",
    "d",
    "date",
    "sales",
    *LAG_COLUMNS,
    "roll_mean_7",
    "roll_mean_14",
    "roll_mean_28",
    "roll_std_7",
    "sell_price",
    "is_weekend",
]


FIRST_DAY = dt.date(1995, 1, 2)  # fixed value: bound of the check


def expectations() -> list[quality.Expectation]:
    checks = [
        quality.columns_match(*SCHEMA),
        quality.not_null("sales"),
        quality.between("sales", *SALES_RANGE),
        quality.mean_between("sales", *MEAN_RANGE),
    ]
    for lag in ("lag_7", "lag_14", "lag_28"):
        checks += [quality.not_null(lag), quality.between(lag, *SALES_RANGE)]
    for mean in ("roll_mean_7", "roll_mean_14", "roll_mean_28"):
        checks += [quality.not_null(mean), quality.between(mean, *ROLLING_RANGE)]
    return checks + [
        quality.between("is_weekend", 0, 1),
        quality.between("day_of_week", 1, 7),
        quality.between("month", 1, 12),
        quality.between("sell_price", *PRICE_RANGE),
        quality.in_set("state_id", STATES),
        quality.in_set("cat_id", CATEGORIES),
        quality.between("date", FIRST_DAY, retail.TRAIN_END),
        quality.unique("item_id", "store_id", "date"),
    ]


def _sql_checks() -> str:
    """The same checks in SQL, one row each."""
    rows = []
    for no, e in enumerate(expectations(), start=1):
        c = e.columns[0]
        name = ",".join(e.columns)
        bad, mean, ok, source = "0", "CAST(NULL AS DOUBLE)", None, "t"
        if e.kind == "not_null":
            bad = f"count(*) FILTER ({c} IS NULL)"
        elif e.kind == "between":
            low, high = (f"DATE '{v}'" if hasattr(v, "year") else repr(v) for v in (e.low, e.high))
            bad = f"count(*) FILTER (NOT ({c} BETWEEN {low} AND {high}))"
        elif e.kind == "in_set":
            bad = f"count(*) FILTER ({c} NOT IN {e.allowed!r})"
        elif e.kind == "mean_between":
            mean = f"avg({c})"
            ok = f"avg({c}) BETWEEN {e.low} AND {e.high}"
        elif e.kind == "columns":
            ok = "false"
        elif e.kind == "unique":
            source = f"(SELECT *, count(*) OVER (PARTITION BY {name}) AS copies FROM t)"
            bad = "count(*) FILTER (copies > 1)"
        rows.append(
            f"""SELECT CAST({no} AS INTEGER) AS check_no, '{e.kind}' AS expectation, '{name}' AS column_name,
                count(*) AS element_count, CAST({bad} AS BIGINT) AS unexpected_count, {mean} AS observed_mean,
                {ok or f'{bad} = 0'} AS success FROM {source}"""
        )
    return "WITH t AS (SELECT * FROM gold WHERE split = 'train') " + " UNION ALL ".join(rows)


CHECKS_SQL = _sql_checks()


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = medallion.gold(spark, sf_dir).filter(F.col("split") == "train").drop("split")
    return quality.check(train, expectations())


@query("dq_report", CHECKS_SQL, ("gold",), six("observed_mean"))
def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir)


@query("dq_failures", f"SELECT * FROM ({CHECKS_SQL}) WHERE NOT success", ("gold",), six("observed_mean"))
def dq_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.failures(results(spark, sf_dir))


@query(
    "dq_summary",
    f"""SELECT count(*) AS evaluated, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed,
               count(*) FILTER (success) / count(*) * 100 AS success_percent, bool_and(success) AS overall_success
        FROM ({CHECKS_SQL})""",
    ("gold",),
    six("success_percent"),
)
def dq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.summary(results(spark, sf_dir))


# The columns of the raw order lines, in order.
LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


PANEL_COLUMNS = (*KEYS, "date", "sales")


def schema_sql(no: int, columns: tuple[str, ...], source: str = "lineitem", same: str | None = None) -> str:
    names = ",".join(columns)
    same = same or f"(SELECT string_agg(column_name, ',') FROM (DESCRIBE lineitem)) = '{names}'"
    return (
        f"SELECT CAST({no} AS INTEGER) AS check_no, 'columns' AS expectation, '{names}' AS column_name, count(*) AS element_count, "
        f"CAST(0 AS BIGINT) AS unexpected_count, CAST(NULL AS DOUBLE) AS observed_mean, {same} AS success FROM {source}"
    )


@query(
    "dq_schema",
    " UNION ALL ".join(
        [schema_sql(1, PANEL_COLUMNS, "panel", "true"), schema_sql(2, PANEL_COLUMNS[::-1], "panel", "false")]
        + [schema_sql(1, LINE_COLUMNS), schema_sql(2, LINE_COLUMNS[::-1])]
    ),
    ("panel",),
)
def dq_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered column lists of the panel and of the raw order lines, and the same lists in the wrong order."""
    tables = [(base(spark, sf_dir, "sales"), PANEL_COLUMNS), (retail.raw(spark, sf_dir, "lineitem"), LINE_COLUMNS)]
    panel, lines = [quality.check(df, [quality.columns_match(*c), quality.columns_match(*c[::-1])]) for df, c in tables]
    return panel.unionByName(lines)


@query(
    "dq_gate",
    f"""SELECT 'all' AS checks, count(*) FILTER (NOT success) > 0 AS raised, count(*) FILTER (NOT success) AS n_failed FROM ({CHECKS_SQL})
        UNION ALL SELECT 'met', false, CAST(0 AS BIGINT) FROM ({CHECKS_SQL}) WHERE success HAVING count(*) > 0""",
    ("gold",),
)
def dq_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the gate stops the job: for all checks, and for those that are met."""
    found = measured(results(spark, sf_dir))
    rows = []
    for name, part in (("all", found), ("met", found.filter("success"))):
        try:
            quality.gate(part)
            rows.append((name, False, 0))
        except quality.QualityGateError as stop:
            rows.append((name, True, stop.n_failed))
    return spark.createDataFrame(rows, "checks string, raised boolean, n_failed long")


@query(
    "dq_unique",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the raw order lines that occur more than once."""
    return quality.duplicates(retail.raw(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
