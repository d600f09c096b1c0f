"""Cutting repeats against a count of all strings."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from panelweave.llm import suffix_levels
from panelweave.llm.suffix_levels import SuffixLevels, cut_repeats


def brute(texts: list[str | None], length: int):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    for r in raws:
        cut = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                cut[i : i + length] = b"\x01" * length
        rest = bytes(b for b, c in zip(r, cut) if not c)
        spans = sum(c and (i == 0 or not cut[i - 1]) for i, c in enumerate(cut))
        yield len(r), sum(cut), spans, hashlib.sha256(rest).hexdigest()


def corpus(rng: random.Random, n: int, alphabet: str) -> list[str | None]:
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(rng.randint(5, 60)) for _ in range(8)]
    texts: list[str | None] = [None, "", "short", None, ""]
    for _ in range(n):
        parts = [prose(rng.randint(0, 40)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts.insert(rng.randint(0, len(parts)), p[a:] if rng.random() < 0.5 else p[: len(p) - a])
        texts.append(" ".join(parts))
    texts += [texts[-1], texts[-1], texts[-2] + "x"]  # exact and near copies
    near = list(texts[-4])
    if near:
        near[len(near) // 2] = "#"
    return [*texts, "".join(near), "ab" * 300, "a" * 700, "ab" * 160]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("length", [50, 120])
def test_equals_brute_force(spark, seed, length):
    texts = corpus(random.Random(seed), 40, "abcdefgé漢" if seed % 2 else "ab")
    rows = [(i if i % 7 else None, t, "extra") for i, t in enumerate(texts)]
    rows += [(3, texts[20], "extra"), (3, texts[20], "extra"), (3, texts[21], "extra")]  # repeated ids and rows
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_bytes string")
    got = cut_repeats(df, length, batches=3).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = [(r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], length))]
    assert Counter(map(tuple, got)) == Counter(want)


def test_kept_text_drops_split_characters(spark):
    shared = "é" * 60
    df = spark.createDataFrame([(1, "x" + shared + "漢y"), (2, "zz" + shared + "字w"), (3, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["kept_text"] for r in cut_repeats(df, 100, keep_text=True).collect()}
    # both end characters begin with the same byte or not; what is left is whole characters
    assert got[3] is None
    assert got[1].startswith("x") and got[1].endswith("y") and got[2].startswith("zz")


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert cut_repeats(df, 400).count() == 0


def test_levels_merge_geometrically(spark):
    family = SuffixLevels()
    for i in range(6):
        found = family.add(spark.createDataFrame([(i,), (100,), (200 + i // 2,)], "head bigint"))
        heads = {r["head"] for r in found.collect()}
        assert (100 in heads) == (i > 0) and (200 + i // 2 in heads) == (i % 2 == 1)
    assert sorted(family.levels) == [1, 2]  # 2 + 4 batches


def test_the_query_returns_the_text_that_is_left(spark, tmp_path):
    from panelweave.llm.queries import QUERIES

    passage = "".join(random.Random(7).choice("abcdefgh ") for _ in range(450))
    rows = [(1, "first " + passage + " end"), (2, "second: " + passage), (3, "alone"), (4, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op7_suffix_levels"](spark, str(tmp_path)).collect()}
    for i, text in rows:
        left = got[i]["text"]
        assert (left is None) == (text is None)
        assert len((left or "").encode()) == got[i]["n_bytes"] - got[i]["n_removed"]
        assert hashlib.sha256((left or "").encode()).hexdigest() == got[i]["kept_sha256"]
    assert got[1]["n_removed"] >= 450 and got[2]["n_removed"] >= 450 and got[3]["text"] == "alone"


def test_strings_whose_middle_stands_nowhere_else_are_not_written(spark, monkeypatch):
    rng, counts, settled = random.Random(5), {}, suffix_levels.settled
    prose = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage, long = prose(340), prose(900)  # too short for the mark, and not
    texts = [prose(600) + passage + prose(600) for _ in range(20)] + [prose(50) + long[a:] + prose(50) for a in (0, 0, 77, 450)]

    def noted(df, name):
        out = settled(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(suffix_levels, "settled", noted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = cut_repeats(df, 400).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == [(i, *b) for i, b in enumerate(brute(texts, 400))]
    assert sum(r["n_removed"] > 0 for r in got) == 4
    assert counts["edges"] < 450  # near the ends of the long passage only; each text has about 100 around the short one
