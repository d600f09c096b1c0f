from __future__ import annotations

import datetime as dt

import pytest

from panelweave.operators import quality
from panelweave.operators.quality import between, columns_match, in_set, mean_between, not_null, unique
from panelweave.plans import feature_queries, medallion
from panelweave.sources import retail

D0 = dt.date(2016, 1, 1)


@pytest.fixture(scope="module")
def table(spark):
    rows = [("a", D0, 1.0), ("a", D0, 3.0), ("b", D0, None), ("c", dt.date(2020, 1, 1), 8.0)]
    return spark.createDataFrame(rows, "k string, d date, v double")


def results(df, *checks):
    return {r.check_no: r for r in quality.check(df, checks).collect()}


def test_each_kind(table):
    got = results(
        table,
        columns_match("k", "d", "v"),
        columns_match("k", "v", "d"),
        not_null("v"),
        between("v", 1.0, 3.0),
        mean_between("v", 4.0, 5.0),
        mean_between("v", 5.0, 9.0),
        in_set("k", ["a", "b"]),
        between("d", D0, D0),
        unique("k", "d"),
        unique("k", "d", "v"),
    )
    assert [got[i].success for i in range(1, 11)] == [True, False, False, False, True, False, False, False, False, True]
    assert [got[i].unexpected_count for i in (3, 4, 7, 8, 9)] == [1, 1, 1, 1, 2]
    assert got[5].observed_mean == 4.0 and {r.element_count for r in got.values()} == {4}


def test_nulls_are_left_to_the_null_check(spark):
    df = spark.createDataFrame([(None,), (1,)], "v int")
    assert results(df, between("v", 0, 5), in_set("v", [1]))[1].success


def test_empty_table(spark):
    df = spark.createDataFrame([], "v double")
    got = results(df, not_null("v"), mean_between("v", 0, 1), unique("v"))
    assert (got[1].success, got[2].success, got[3].success) == (True, False, True)


def test_summary_failures_and_gate(table):
    good, bad = quality.check(table, [not_null("k")]), quality.check(table, [not_null("k"), not_null("v")])
    s = quality.summary(bad).first()
    assert (s.evaluated, s.successful, s.failed, s.success_percent, s.overall_success) == (2, 1, 1, 50.0, False)
    assert [r.column_name for r in quality.failures(bad).collect()] == ["v"]
    quality.gate(good)
    with pytest.raises(quality.QualityGateError, match=r"1 checks failed: not_null\(v\)"):
        quality.gate(bad)


def test_duplicates(table):
    assert [(r.k, r.n_rows) for r in quality.duplicates(table, ["k", "d"]).collect()] == [("a", 2)]


def test_schema_checks_cover_the_whole_panel(spark, sf_dir):
    found = {(r.column_name, r.element_count, r.success) for r in feature_queries.dq_schema(spark, sf_dir).collect()}
    n_panel, n_lines = medallion.silver(spark, sf_dir).count(), retail.raw(spark, sf_dir, "lineitem").count()
    assert ("item_id,store_id,date,sales", n_panel, True) in found and ("sales,date,store_id,item_id", n_panel, False) in found
    assert len(found) == 4 and {n for _, n, _ in found} == {n_panel, n_lines}
