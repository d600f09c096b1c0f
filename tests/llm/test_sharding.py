"""Hilbert shards: the law, the slots, the curve itself."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelweave.llm.corpus import numbered
from panelweave.llm.sharding import hilbert_index, hilbert_shards

SCHEMA = "doc_id bigint, text string, lang string, source string, shard string, curve int"


def rows(n):
    texts = [None, "", "é" * 40, "same", "same", "x" * 5000]
    return [(i if i % 11 else None, texts[i % 6], ["en", "fr", None][i % 3], "hot" if i % 3 else f"s{i}", "clash", 1) for i in range(n)]


@pytest.mark.parametrize("bits,n", [(2, 2), (3, 2), (2, 3)])
def test_neighbours_on_the_curve_are_neighbours_in_space(spark, bits, n):
    points = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(points, ", ".join(f"c{i} bigint" for i in range(n)))
    got = {tuple(r[:n]): r[n] for r in df.select("*", hilbert_index([F.col(f"c{i}") for i in range(n)], bits)).collect()}
    by_index = {v: k for k, v in got.items()}
    assert sorted(by_index) == list(range(len(points)))
    for i in range(len(points) - 1):
        assert sum(abs(a - b) for a, b in zip(by_index[i], by_index[i + 1])) == 1


@pytest.mark.parametrize("n", [0, 1, 5, 16, 203])
def test_rows_law_and_slots(spark, n):
    df = spark.createDataFrame(rows(n) * (2 if n == 5 else 1), SCHEMA)
    got = hilbert_shards(df, 16).collect()
    assert len(got) == df.count()
    counts = Counter(r["shard"] for r in got)
    assert all(0 <= s < 16 for s in counts)
    if n:
        assert max(counts.values()) - min(counts.get(s, 0) for s in range(16)) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert {r["law"] for r in got} <= {"rows"} and {r["grown_shard"] for r in got} <= {None}
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows(n) * (2 if n == 5 else 1))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_shards_follow_the_curve(spark):
    got = hilbert_shards(spark.createDataFrame(rows(300), SCHEMA), 16).orderBy("shard", "slot").collect()
    curve = [r["curve"] for r in got]
    assert curve == sorted(curve)


def test_running_sums(spark):
    df = spark.createDataFrame([(i, i % 5 + 1) for i in range(100)], "k bigint, w bigint")
    got = numbered(df, [F.col("k")], weight="w").orderBy("k").collect()
    assert [r["position"] for r in got] == list(itertools.accumulate([0, *(i % 5 + 1 for i in range(99))]))
