from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.operators import encodings, features, reshape, ranges

D0 = dt.date(2016, 1, 1)


def one_series(spark, values):
    return spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "k string, t int, v double")


def by_time(df, column):
    return [r[column] for r in df.orderBy("t").collect()]


@pytest.fixture(scope="module")
def random_panel():
    rng = np.random.default_rng(7)
    rows = []
    for k in ("a", "b", "c"):
        v = rng.poisson(5, 60) * rng.uniform(0.5, 1.5)
        v = np.where(rng.random(60) < 0.1, np.nan, v)
        rows += [(k, i, None if np.isnan(x) else float(x)) for i, x in enumerate(v)]
    return rows


def test_rolling_and_lag_by_hand(spark):
    df = one_series(spark, [1.0, 3.0, None, 5.0])
    rolled = features.add_rolling(df, ["k"], "t", "v", windows=(2,), statistics=("mean", "std"))
    assert by_time(rolled, "roll_mean_2") == [None, 1.0, 2.0, 3.0]
    std = by_time(rolled, "roll_std_2")
    assert std[:2] == [None, None] and std[2] == pytest.approx(2**0.5) and std[3] is None
    assert by_time(features.add_lags(df, ["k"], "t", "v", (1,)), "lag_1") == [None, 1.0, 3.0, None]


@pytest.mark.parametrize("windows", [(7, 14, 28), (3, 5), (6,)])
@pytest.mark.parametrize("full", [False, True])
def test_rolling_equals_pandas(spark, random_panel, windows, full):
    df = spark.createDataFrame(random_panel, "k string, t int, v double")
    got = features.add_rolling(df, ["k"], "t", "v", windows=windows, full_window=full).toPandas().sort_values(["k", "t"])
    shifted = got.groupby("k")["v"].shift(1)
    for w in windows:
        rolling = shifted.groupby(got["k"]).rolling(w, min_periods=w if full else 1)
        for name in features.STATISTICS:
            expected = getattr(rolling, name)().reset_index(level=0, drop=True)
            if name == "std" and full:
                expected = expected.where(rolling.count().reset_index(level=0, drop=True) == w)
            np.testing.assert_allclose(
                got[f"roll_{name}_{w}"].astype(float), expected.reindex(got.index), atol=1e-9, err_msg=f"{name} {w}"
            )


def test_features_do_not_see_the_current_row(spark, random_panel):
    df = spark.createDataFrame(random_panel, "k string, t int, v double")
    shocked = df.withColumn("v", F.when(F.col("t") == 40, 1e6).otherwise(F.col("v")))
    made = [features.add_rolling(features.add_lags(d, ["k"], "t", "v"), ["k"], "t", "v").drop("v") for d in (df, shocked)]
    upto = [sorted(d.filter("t <= 40").collect(), key=str) for d in made]
    after = [sorted(d.filter("t = 41").collect(), key=str) for d in made]
    assert upto[0] == upto[1] and after[0] != after[1]


def test_calendar_of_a_sunday(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 7),)], "date date")
    r = features.add_calendar(df, "date").first()
    assert (r.day_of_week, r.week_of_year, r.quarter, r.is_weekend, r.day_of_month, r.month, r.year) == (1, 1, 1, 1, 7, 1, 2024)


def test_price_change(spark):
    df = one_series(spark, [2.0, 3.0, None, 4.0])
    r = features.add_price(df, ["k"], "t", "v").orderBy("t").collect()
    assert [x.price_lag_1 for x in r] == [None, 2.0, 3.0, None]
    assert r[1].price_change == 1.0 and r[1].price_pct_change == pytest.approx(0.5)


def test_zscore(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("same", 0.1), ("same", 0.1), ("same", 0.1), ("one", 5.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r.g, r.x): r.z for r in features.add_group_zscore(df, ["g"], "x", "z").collect()}
    assert got[("a", 3.0)] == pytest.approx(1.0) and got[("a", None)] is None
    assert got[("same", 0.1)] == 0.0 and got[("one", 5.0)] is None


def test_event_codes(spark):
    df = spark.createDataFrame([("b",), ("b",), ("a",), ("c",), (None,)], "e string")
    codes = encodings.fit_event_codes(df, "e")
    got = {r.e: r.code for r in encodings.apply_event_codes(df, codes, "e", "code").collect()}
    assert got == {"b": 0, "a": 1, "c": 2, None: 3}
    alpha = encodings.fit_event_codes(df, "e", order="alphabetical")
    got = {r.e: r.code for r in encodings.apply_event_codes(df, alpha, "e", "code", missing=-1).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, None: -1}


@pytest.mark.parametrize("weight", [0.0, 3.0])
def test_target_encoding_is_fitted_on_train_only(spark, weight):
    train = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 8.0)], "g string, h string, v double")
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("new", "x"), (None, "x")], "g string, h string")
    got = encodings.apply_target_encoding(rows, encodings.fit_target_encoding(train, ["g", "h"], "v", weight)).collect()
    smooth = lambda total, n: (total + weight * 4.0) / (n + weight)
    te = {(r.g, r.h): (r.te_g, r.te_h) for r in got}
    assert te[("a", "x")] == pytest.approx((smooth(4.0, 2), smooth(9.0, 2)))
    assert te[("b", "y")] == pytest.approx((smooth(8.0, 1), smooth(3.0, 1)))
    assert te[("new", "x")][0] == te[(None, "x")][0] == 4.0


def test_split_bounds(spark):
    df = spark.createDataFrame([(D0 + dt.timedelta(days=i),) for i in range(7)], "date date")
    day = lambda i: D0 + dt.timedelta(days=i)
    got = {r.date: r.split for r in reshape.temporal_split(df, "date", day(2), day(3), day(5), day(1)).collect()}
    assert got == {day(1): "train", day(2): "train", day(3): "val", day(4): "test", day(5): "test"}


def test_densify_unpivot_and_fill(spark):
    sparse = spark.createDataFrame([("a", D0, 2.0), ("b", D0 + dt.timedelta(days=2), 3.0)], "k string, date date, v double")
    dense = reshape.densify(sparse, reshape.describe_series(sparse, ["k"], []), ["k"], "date", D0, D0 + dt.timedelta(days=2), {"v": 0.0})
    assert sorted((r.k, (r.date - D0).days, r.v) for r in dense.collect()) == [
        ("a", 0, 2.0), ("a", 1, 0.0), ("a", 2, 0.0), ("b", 0, 0.0), ("b", 1, 0.0), ("b", 2, 3.0),
    ]
    wide = spark.createDataFrame([("a", 1, 2, "other")], "id string, d_1 int, d_2 int, x string")
    assert sorted(tuple(r) for r in reshape.unpivot_days(wide, ["id"]).collect()) == [("a", "d_1", 1), ("a", "d_2", 2)]
    gaps = one_series(spark, [None, 2.0, None, 5.0, None])
    assert by_time(reshape.fill_within_series(gaps, ["k"], "t", ["v"]), "v") == [2.0, 2.0, 2.0, 5.0, 5.0]
    assert by_time(reshape.fill_within_series(one_series(spark, [None, None]), ["k"], "t", ["v"]), "v") == [0.0, 0.0]


def test_samples_repeat_and_keep_whole_series(spark, random_panel):
    df = spark.createDataFrame(random_panel, "k string, t int, v double")
    a, b = (sorted(reshape.sample_rows(df, ["k", "t"], 0.3).collect(), key=str) for _ in range(2))
    assert a == b and 20 < len(a) < 90
    chosen = reshape.sample_series(df, ["k"], 1.0, 2)
    assert chosen.groupBy("k").count().collect()[0]["count"] == 60 and chosen.select("k").distinct().count() == 2
    parts = reshape.random_split(df, ["k", "t"], 0.5).groupBy("part").count().collect()
    assert sum(r["count"] for r in parts) == 180 and len(parts) == 2


def test_patches_cover_the_lookback(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(100)], "k string, t int, v double")
    got = {r.patch: r for r in reshape.patches(df, ["k"], "t", "v").collect()}
    assert sorted(got) == list(range(13)) and reshape.patch_count(104, 16, 8) == 12
    assert got[0].patch_values == [float(x) for x in range(44, 52)] and got[12].patch_values[-1] == 99.0
    assert all(len(r.patch_values) == 8 and r.last_step - r.first_step == 7 for r in got.values())


def test_missing_columns_warn(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.warns(UserWarning, match="b"):
        assert reshape.available(df, ["b", "a"]) == ["a"]


def test_drop_incomplete(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 4)], "a int, b int")
    assert reshape.drop_incomplete(df).count() == 1 and reshape.drop_incomplete(df, ["a"]).count() == 2


def test_panel_frame_fills_and_clips(spark):
    rows = [("i", "s", D0 + dt.timedelta(days=n), y, p, f) for n, (y, p, f) in enumerate([(-1.0, None, None), (None, 2.0, 1)])]
    df = spark.createDataFrame(rows, "item string, store string, date date, sales double, price double, flag int")
    got = reshape.panel_frame(df, ["item", "store"], "date", "sales", ["price"], ["flag"]).orderBy("ds").collect()
    assert [(r.unique_id, r.y, r.price, r.flag) for r in got] == [("i_s", 0.0, 2.0, 0), ("i_s", 0.0, 2.0, 1)]
    assert reshape.panel_frame(df, ["item", "store"], "date", "sales", ["price"], ["flag"], min_length=3).count() == 0


def test_pandas_has_the_same_percentiles(spark):
    from panelweave.operators import explore

    values = [0.0, 0.0, 1.0, 2.0, 7.0, 9.0]
    r = explore.distribution(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert [r.p25, r.p50, r.p75] == list(pd.Series(values).quantile([0.25, 0.5, 0.75]))


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000])
def test_quantiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    values = [*rng.normal(0, 1, n // 2).tolist(), *rng.integers(0, 4, n - n // 2).astype(float).tolist()]
    df = spark.createDataFrame([(v,) for v in [*values, None, None]], "v double").repartition(5)
    got = tuple(ranges.quantiles(df, "v", (0.0, 0.25, 0.5, 0.9, 1.0)).first())
    assert got == pytest.approx(tuple(np.quantile(values, (0, 0.25, 0.5, 0.9, 1)))) if n else got == (None,) * 5


def test_running_sums_and_next_rows(spark):
    df = spark.createDataFrame([(i, i % 5 + 1) for i in range(200)], "k int, w int")
    assert {r.k: r.s for r in ranges.running_sum(df, ["k"], "w", "s").collect()} == {i: sum(j % 5 + 1 for j in range(i)) for i in range(200)}
    assert {r.k: r.n.k for r in ranges.with_next(df, ["k"], ["k"], "n").collect()} == {i: (i + 1) % 200 for i in range(200)}


def test_zscore_by_pairs_of_series_and_group_is_the_same(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(f"s{i % 9}", f"g{i % 4}", float(v)) for i, v in enumerate(rng.normal(0, 1, 400))] + [("s0", None, 1.0), ("s1", "g0", None)], "s string, g string, v double")
    direct = features.add_group_zscore(df, ["g"], "v", "z").select("s", "g", "v", F.round("z", 9).alias("z"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        pairs = features.add_group_zscore(df, ["g"], "v", "z", ["s"]).select("s", "g", "v", F.round("z", 9).alias("z"))
        assert sorted(map(str, pairs.collect())) == sorted(map(str, direct.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
