"""Z-order: the key, the levels, and the row groups that a reader of one value opens."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.sources import layout


def test_interleaved_bits(spark):
    points = list(itertools.product(range(8), range(8)))
    df = spark.createDataFrame(points, "x long, y long")
    got = {(r.x, r.y): r.z for r in df.withColumn("z", layout.interleaved([F.col("x"), F.col("y")], 3)).collect()}
    assert sorted(got.values()) == list(range(64))
    assert all(z == sum(((x >> b & 1) << (2 * b + 1)) | ((y >> b & 1) << (2 * b)) for b in range(3)) for (x, y), z in got.items())


def test_levels_share_the_rows_and_keep_the_order(spark):
    rng = np.random.default_rng(1)
    values = [None] * 50 + rng.lognormal(0, 2, 2000).round(3).tolist() + [5.0] * 900
    df = spark.createDataFrame([(v,) for v in values], "v double")
    levels = sorted(((r._value is not None, r._value or 0), r._level) for r in layout.rank_levels(df, "v", 4).collect())
    assert [lv for _, lv in levels] == sorted(lv for _, lv in levels) and {lv for _, lv in levels} <= set(range(16))
    rows = {}
    at = {k: lv for k, lv in levels}
    for v in values:
        rows[at[(v is not None, v or 0)]] = rows.get(at[(v is not None, v or 0)], 0) + 1
    assert sorted(rows.values())[-2] < 2 * len(values) / 16  # but for the level of the hot value


def test_every_row_is_written_once_and_a_value_opens_few_groups(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"a{int(a)}" if a else None, int(b), f"t{i}") for i, (a, b) in enumerate(rng.integers(0, 200, (40_000, 2)))]
    df = spark.createDataFrame(rows + rows[:5], "a string, b int, _value string")
    z, s = str(tmp_path / "z"), str(tmp_path / "s")
    layout.write_zordered(df, z, ["a", "b"], row_group_bytes=1 << 12)
    df.repartitionByRange("a", "b").sortWithinPartitions("a", "b").write.option("parquet.block.size", 1 << 12).parquet(s)
    assert sorted(map(str, spark.read.parquet(z).collect())) == sorted(map(str, df.collect()))
    share = {}
    for name, path in (("z", z), ("s", s)):
        groups = layout.row_groups(spark, path, ["a", "_value"])
        assert groups.agg(F.sum("n_rows")).first()[0] == 40_005
        read = layout.groups_read(groups, "a", F.lit("a77")).first()
        share[name] = read.groups_read / read.n_groups
    assert share["s"] < share["z"] < 0.5


def test_small_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    layout.write_zordered(df, str(tmp_path / "one"), ["a", "b"])
    assert spark.read.parquet(str(tmp_path / "one")).collect() == df.collect()
    layout.write_zordered(df.limit(0), str(tmp_path / "none"), ["a", "b"])
    assert spark.read.schema(df.schema).parquet(str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        layout.write_zordered(df, str(tmp_path / "no"), ["a", "b"], bits=40)
