"""Merkle manifest: trees of every shape by brute force, tampering, nulls, repeated rows."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from panelweave.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, digest string, `group` string, rank int, n int, item int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def climb(nodes):
    """Root of a list of digests, and for each the siblings (left, right) per level."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
            paths[i].append((run[: p % 16], run[p % 16 + 1 :]))
            place[i] = p // 16
        nodes = [H(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        ordered = sorted((((r[0] is not None, r[0] or 0), leaf(r, r[4]), r) for r in groups[s]), key=lambda x: x[:2])
        trees[s] = ([r for *_, r in ordered], *climb([d for _, d, _ in ordered]))
    root, above = climb([trees[s][1] for s in names])
    out = []
    for s, up in zip(names, above):
        ordered, subroot, paths = trees[s]
        for r, path in zip(ordered, paths):
            own = leaf(r, r[4])
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            x = leaf(r, lower(r[4])) if hit else own
            for a, b in path + up:
                x = H(*a, x, *b)
            out.append((r[0], own, subroot, root, H(*[d for a, b in path + up for d in a + b]), x, x == root))
    return sorted(out, key=str)


def answer(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash", 1, 2, 3) for r in rows], SCHEMA)
    out = merkle.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in out.collect()), key=str)


def made(n, sources):
    texts = [None, "", "Text WITH capitals É", "lower only", "x" * 50_000]
    return [(i, sources[i % len(sources)], [None, "en"][i % 2], None if i % 7 == 0 else i, texts[i % 5]) for i in range(n)]


@pytest.mark.parametrize("n,sources", [(1, ["s"]), (1, [None]), (16, ["s"]), (17, ["s"]), (290, ["hot", "hot", "hot", None, "é", "z"]), (4200, ["s"])])
def test_equals_brute_force(spark, n, sources):
    rows = made(n, sources)
    assert answer(spark, rows) == brute(rows)


def test_many_sources(spark):
    rows = made(600, [None, "", *[f"s{i}" for i in range(298)]])
    assert answer(spark, rows) == brute(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, "a", None, None, None), (None, "a", "en", 1, "T"), (3, "a", "en", 1, "A"), (3, "a", "en", 1, "B"), (3, "a", "en", 1, "B"), (-5, "a", "en", 1, "N")]
    assert answer(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert answer(spark, []) == []


def test_tampering_shows_where_a_capital_is_lost(spark):
    got = {r[0]: r for r in answer(spark, made(300, ["a", "b"]))}
    tampered = {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i in got if not got[i][6]} == {i for i in tampered if i % 5 == 2} != set()


def test_no_row_holds_a_group(spark):
    """Blocks hold 256 nodes at most, and the proofs of leaves come without a join on leaves."""
    nodes = spark.range(1000).select(F.lit("g").alias("group"), F.col("id").alias("rank"), F.lit(1000).cast("long").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.col("id").alias("item"))
    blocks = merkle.rollup(nodes)
    sizes = blocks.select(F.aggregate("runs", F.lit(0), lambda a, r: a + F.size(r["leaves"])).alias("k"), "n").collect()
    assert sorted(r["k"] for r in sizes) == [232, 256, 256, 256] and {r["n"] for r in sizes} == {4}
