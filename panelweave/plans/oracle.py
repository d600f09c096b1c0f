"""Common table expressions shared by the SQL twins: the same tables, written in SQL.

Each entry is ``name: (needed tables, body)``; ``with_ctes`` puts the needed ones in order.
"""

from __future__ import annotations

from collections.abc import Sequence

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "daily": (
        (),
        """
        SELECT p_type AS item_id, n_name AS store_id, r_name AS state_id, CAST(l_shipdate AS DATE) AS date,
               sum(l_quantity) AS sales,
               CAST(sum(CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT)) AS BIGINT) AS unit_cents,
               count(*) AS n_lines
        FROM lineitem
        JOIN part ON l_partkey = p_partkey
        JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
        GROUP BY 1, 2, 3, 4""",
    ),
    "prices": (
        ("daily",),
        """
        SELECT store_id, item_id, CAST(isoyear(date) * 100 + week(date) AS INTEGER) AS wm_yr_wk,
               round(CAST(sum(unit_cents) AS DOUBLE) / CAST(sum(n_lines) AS DOUBLE)) / 100 AS sell_price
        FROM daily GROUP BY 1, 2, 3""",
    ),
    "calendar": (
        ("daily",),
        """
        SELECT 'd_' || CAST(date - (SELECT min(date) FROM daily) + 1 AS VARCHAR) AS d, date,
               CAST(isoyear(date) * 100 + week(date) AS INTEGER) AS wm_yr_wk,
               dayname(date) AS weekday, CAST(dayofweek(date) + 1 AS INTEGER) AS wday,
               CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year,
               CASE strftime(date, '%m-%d') WHEN '01-01' THEN 'NewYear' WHEN '07-04' THEN 'Independence'
                    WHEN '12-25' THEN 'Christmas' END AS event_name_1,
               CASE strftime(date, '%m-%d') WHEN '01-01' THEN 'National' WHEN '07-04' THEN 'National'
                    WHEN '12-25' THEN 'Religious' END AS event_type_1,
               CAST(day(date) BETWEEN 1 AND 10 AS INTEGER) AS snap_A,
               CAST(day(date) BETWEEN 6 AND 15 AS INTEGER) AS snap_B,
               CAST(day(date) BETWEEN 11 AND 20 AS INTEGER) AS snap_C
        FROM (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily)""",
    ),
    "series": (
        ("daily",),
        """
        SELECT DISTINCT item_id,
               CASE item_id WHEN 'SMALL' THEN 'SIZE_1' WHEN 'MEDIUM' THEN 'SIZE_1' WHEN 'LARGE' THEN 'SIZE_2'
                    WHEN 'ECONOMY' THEN 'LINE_1' WHEN 'STANDARD' THEN 'LINE_1' WHEN 'PROMO' THEN 'LINE_2' END AS dept_id,
               CASE WHEN item_id IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'SIZE' ELSE 'LINE' END AS cat_id,
               store_id, state_id
        FROM daily""",
    ),
    "panel": (
        ("series", "calendar", "daily"),
        """
        SELECT s.*, c.d, c.date, coalesce(y.sales, 0.0) AS sales
        FROM series s CROSS JOIN calendar c
        LEFT JOIN daily y ON y.item_id = s.item_id AND y.store_id = s.store_id AND y.date = c.date""",
    ),
    "silver": (
        ("panel", "calendar", "prices"),
        """
        SELECT x.item_id, x.dept_id, x.cat_id, x.store_id, x.state_id, x.d, x.date, x.sales,
               c.* EXCLUDE (d, date), p.sell_price
        FROM panel x JOIN calendar c ON x.d = c.d
        LEFT JOIN prices p ON p.store_id = x.store_id AND p.item_id = x.item_id AND p.wm_yr_wk = c.wm_yr_wk""",
    ),
    # Rows that gold keeps, by split, without the features.
    "splits": (
        ("silver",),
        """
        SELECT *, CASE WHEN date <= DATE '2001-06-03' THEN 'train' WHEN date <= DATE '2001-07-01' THEN 'val'
                       ELSE 'test' END AS split
        FROM silver WHERE date >= (SELECT min(date) + 28 FROM daily) AND date <= DATE '2001-07-29'""",
    ),
    "lagged": (
        ("silver",),
        """
        SELECT *, """
        + ", ".join(f"lag(sales, {k}) OVER w AS lag_{k}" for k in (1, 7, 14, 28))
        + """
        FROM silver WINDOW w AS (PARTITION BY item_id, store_id ORDER BY date)""",
    ),
    "rolled": (
        ("lagged",),
        """
        SELECT *, """
        + ", ".join(
            f"{f}(sales) OVER w{k} AS roll_{n}_{k}"
            for k in (7, 14, 28)
            for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
        )
        + """
        FROM lagged WINDOW """
        + ", ".join(
            f"w{k} AS (PARTITION BY item_id, store_id ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
            for k in (7, 14, 28)
        ),
    ),
    "priced": (
        ("silver",),
        """
        SELECT item_id, store_id, date, price_lag_1, sell_price - price_lag_1 AS price_change,
               (sell_price - price_lag_1) / (price_lag_1 + 1e-8) AS price_pct_change
        FROM (SELECT *, lag(sell_price) OVER (PARTITION BY item_id, store_id ORDER BY date) AS price_lag_1 FROM silver)""",
    ),
    "normed": (
        ("silver",),
        """
        SELECT item_id, store_id, date,
               CASE WHEN stddev_samp(sell_price) OVER g IS NULL THEN NULL
                    WHEN min(sell_price) OVER g = max(sell_price) OVER g THEN sell_price * 0
                    ELSE (sell_price - avg(sell_price) OVER g) / (stddev_samp(sell_price) OVER g + 1e-8) END AS price_norm_store
        FROM silver WINDOW g AS (PARTITION BY store_id, wm_yr_wk)""",
    ),
    "event_codes": (
        ("silver",),
        """
        SELECT event_name_1, CAST(row_number() OVER (ORDER BY count(*) DESC, event_name_1) - 1 AS INTEGER) AS code
        FROM silver WHERE event_name_1 IS NOT NULL GROUP BY event_name_1""",
    ),
    "gold": (
        ("rolled", "priced", "normed", "event_codes"),
        """
        SELECT * FROM (SELECT r.* EXCLUDE (month, year), q.* EXCLUDE (item_id, store_id, date),
               CAST(dayofweek(r.date) + 1 AS INTEGER) AS day_of_week, CAST(day(r.date) AS INTEGER) AS day_of_month,
               CAST(week(r.date) AS INTEGER) AS week_of_year, CAST(month(r.date) AS INTEGER) AS month,
               CAST(year(r.date) AS INTEGER) AS year, CAST(quarter(r.date) AS INTEGER) AS quarter,
               CAST(dayofweek(r.date) IN (0, 6) AS INTEGER) AS is_weekend, z.price_norm_store,
               avg(sales) FILTER (r.date <= DATE '2001-06-03') OVER (PARTITION BY dept_id) AS te_dept_id,
               avg(sales) FILTER (r.date <= DATE '2001-06-03') OVER (PARTITION BY cat_id) AS te_cat_id,
               avg(sales) FILTER (r.date <= DATE '2001-06-03') OVER (PARTITION BY r.store_id) AS te_store_id,
               avg(sales) FILTER (r.date <= DATE '2001-06-03') OVER (PARTITION BY state_id) AS te_state_id,
               coalesce(e.code, CAST((SELECT count(*) FROM event_codes) AS INTEGER)) AS event_name_encoded,
               CASE WHEN r.date <= DATE '2001-06-03' THEN 'train' WHEN r.date <= DATE '2001-07-01' THEN 'val'
                    ELSE 'test' END AS split
        FROM rolled r
        JOIN priced q ON q.item_id = r.item_id AND q.store_id = r.store_id AND q.date = r.date
        JOIN normed z ON z.item_id = r.item_id AND z.store_id = r.store_id AND z.date = r.date
        LEFT JOIN event_codes e ON e.event_name_1 = r.event_name_1) WHERE lag_28 IS NOT NULL AND date <= DATE '2001-07-29'""",
    ),
    # Three forecasts that SQL can make too: same weekday, mean of 28 days, last value.
    "forecasts": (
        ("splits", "series"),
        """
        SELECT h.item_id, h.store_id, CAST(h.date + 7 * CAST(k AS INTEGER) AS DATE) AS ds, 'naive7' AS model, h.sales AS yhat
        FROM splits h CROSS JOIN range(1, 5) AS weeks(k)
        WHERE h.date BETWEEN DATE '2001-05-28' AND DATE '2001-06-03'
        UNION ALL
        SELECT h.item_id, h.store_id, DATE '2001-06-03' + CAST(k AS INTEGER), 'mean28', h.level
        FROM (SELECT item_id, store_id, avg(sales) AS level FROM splits
              WHERE date BETWEEN DATE '2001-05-07' AND DATE '2001-06-03' GROUP BY 1, 2) h CROSS JOIN range(1, 29) AS days(k)
        UNION ALL
        SELECT h.item_id, h.store_id, DATE '2001-06-03' + CAST(k AS INTEGER), 'last1', h.sales
        FROM splits h CROSS JOIN range(1, 29) AS days(k) WHERE h.date = DATE '2001-06-03'""",
    ),
    "evaluated": (
        ("forecasts", "splits"),
        """
        SELECT f.item_id, f.store_id, a.dept_id, a.cat_id, f.ds, f.model, a.sales AS y, f.yhat
        FROM forecasts f
        JOIN splits a ON a.item_id = f.item_id AND a.store_id = f.store_id AND a.date = f.ds AND a.split = 'val'""",
    ),
    "errors": (
        ("evaluated",),
        """
        SELECT *, (y - yhat) * (y - yhat) AS sq, abs(y - yhat) AS ae,
               abs(y - yhat) / ((abs(y) + abs(yhat)) / 2 + 1e-8) AS sm
        FROM evaluated""",
    ),
    "scale7": (
        ("splits",),
        """
        SELECT item_id, store_id, sum(diff * diff) AS sum_squared, sum(abs(diff)) AS sum_absolute,
               count(diff) AS n_differences, sum(diff * diff) / count(diff) + 1e-8 AS squared_scale,
               sum(abs(diff)) / count(diff) + 1e-8 AS absolute_scale
        FROM (SELECT item_id, store_id, sales - lag(sales, 7) OVER (PARTITION BY item_id, store_id ORDER BY date) AS diff
              FROM splits WHERE split = 'train')
        GROUP BY 1, 2""",
    ),
    "scale1": (
        ("splits",),
        """
        SELECT item_id, store_id, sum(diff * diff) AS sum_squared, sum(abs(diff)) AS sum_absolute,
               count(diff) AS n_differences, sum(diff * diff) / count(diff) + 1e-8 AS squared_scale,
               sum(abs(diff)) / count(diff) + 1e-8 AS absolute_scale
        FROM (SELECT item_id, store_id, sales - lag(sales) OVER (PARTITION BY item_id, store_id ORDER BY date) AS diff
              FROM splits WHERE split = 'train')
        GROUP BY 1, 2""",
    ),
    # Logged runs: each model under other metric names, one without rmse, one not finished.
    "model_metrics": (
        ("errors", "scale1"),
        """
        SELECT model, sqrt(avg(sq)) AS rmse, avg(ae) AS mae, avg(sm) * 100 AS smape,
               sqrt(avg(sq) / (SELECT sum(sum_squared) / sum(n_differences) + 1e-8 FROM scale1)) AS rmsse
        FROM errors GROUP BY model""",
    ),
    "runs": (
        ("model_metrics",),
        """
        SELECT r.run_id, r.run_name, r.status, r.start_millis, r.metric,
               CASE r.col WHEN 'rmse' THEN m.rmse WHEN 'mae' THEN m.mae WHEN 'smape' THEN m.smape ELSE m.rmsse END AS value
        FROM (VALUES
          ('run-0001-naive7', 'naive7_weekly', 'FINISHED', 990000000000, 'naive7', 'rmsse', 'val_rmsse'),
          ('run-0001-naive7', 'naive7_weekly', 'FINISHED', 990000000000, 'naive7', 'rmse', 'val_rmse'),
          ('run-0001-naive7', 'naive7_weekly', 'FINISHED', 990000000000, 'naive7', 'mae', 'val_mae'),
          ('run-0001-naive7', 'naive7_weekly', 'FINISHED', 990000000000, 'naive7', 'smape', 'val_smape'),
          ('run-0002-mean28', 'Mean28_level', 'FINISHED', 990003600000, 'mean28', 'rmsse', 'test_rmsse'),
          ('run-0002-mean28', 'Mean28_level', 'FINISHED', 990003600000, 'mean28', 'rmse', 'test_rmse'),
          ('run-0002-mean28', 'Mean28_level', 'FINISHED', 990003600000, 'mean28', 'mae', 'test_mae'),
          ('run-0002-mean28', 'Mean28_level', 'FINISHED', 990003600000, 'mean28', 'smape', 'test_smape'),
          ('run-0003-last1', 'last1_value', 'FINISHED', 990007200000, 'last1', 'rmse', 'rmse'),
          ('run-0003-last1', 'last1_value', 'FINISHED', 990007200000, 'last1', 'mae', 'mae'),
          ('run-0003-last1', 'last1_value', 'FINISHED', 990007200000, 'last1', 'smape', 'smape_pct'),
          ('run-0004-partial', 'mean28_partial', 'FINISHED', 990010800000, 'mean28', 'mae', 'val_mae'),
          ('run-0005-open', 'naive7_open', 'RUNNING', 990014400000, 'naive7', 'rmse', 'val_rmse')
        ) AS r(run_id, run_name, status, start_millis, model, col, metric)
        JOIN model_metrics m USING (model)""",
    ),
    "board": (
        ("runs",),
        """
        SELECT run_name, substr(run_id, 1, 8) AS run_id,
               round(coalesce(max(value) FILTER (metric = 'val_rmsse'), max(value) FILTER (metric = 'test_rmsse'),
                              max(value) FILTER (metric = 'rmsse')), 4) AS rmsse,
               round(coalesce(max(value) FILTER (metric = 'val_rmse'), max(value) FILTER (metric = 'test_rmse'),
                              max(value) FILTER (metric = 'rmse')), 4) AS rmse,
               round(coalesce(max(value) FILTER (metric = 'val_mae'), max(value) FILTER (metric = 'test_mae'),
                              max(value) FILTER (metric = 'mae')), 4) AS mae,
               round(coalesce(max(value) FILTER (metric = 'val_smape'), max(value) FILTER (metric = 'test_smape'),
                              max(value) FILTER (metric = 'smape_pct'), max(value) FILTER (metric = 'smape')), 4) AS smape,
               strftime(epoch_ms(start_millis), '%Y-%m-%d %H:%M') AS start_time,
               split_part(lower(run_name), '_', 1) AS model_family
        FROM runs WHERE status = 'FINISHED'
        GROUP BY run_id, run_name, start_millis
        HAVING rmse IS NOT NULL""",
    ),
    # Test rows with the fixed linear formula of the what-if twins; missing values are 0.
    "scored": (
        ("lagged",),
        """
        SELECT item_id, store_id, date, sales, coalesce(lag_7, 0.0) AS lag_7, coalesce(sell_price, 0.0) AS sell_price,
               CAST(snap_A AS DOUBLE) AS snap_A,
               2.0 + 0.5 * coalesce(lag_7, 0.0) + -0.001 * coalesce(sell_price, 0.0) + 1.5 * snap_A AS raw
        FROM lagged WHERE date > DATE '2001-07-01' AND date <= DATE '2001-07-29'""",
    ),
}


def with_ctes(names: Sequence[str], sql: str) -> str:
    """Put the named common tables, and those they need, in front of a query."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for needed in CTES[name][0]:
                visit(needed)
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered) + f"\nSELECT * FROM ({sql})"
