"""Every registered query against its SQL, or by its rows where SQL cannot say it."""

from __future__ import annotations

import pytest
from compare import difference, duck, operators

import __spark_entry__ as entry
from panelweave.plans.catalog import QUERIES as PANEL

QUERIES = {name: run for name, run in entry.queries().items() if name in PANEL}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in PANEL}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def no_all_pairs(df):
    """The plan pairs no rows but those that share a key."""
    assert not {"CartesianProduct", "BroadcastNestedLoopJoin"} & set(operators(df))
    return df


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, con, sf_dir):
    assert difference(no_all_pairs(QUERIES[name](spark, sf_dir)), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(name, spark, sf_dir):
    df = no_all_pairs(QUERIES[name](spark, sf_dir))
    rows = df.collect()
    assert rows
    for column, kind in df.dtypes:
        if kind == "double" and column != "sweep_value":
            assert all(r[column] is not None for r in rows), column


def test_entry_is_stable(spark):
    df = entry.entry(spark)
    assert df.columns == ["cat_id", "model", "rmsse", "mase", "smape", "rmse", "mae", "n_series"]
    assert df.count() == 6
