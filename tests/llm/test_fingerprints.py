"""Winnowing against its definition; the edited text and the next document."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from panelweave.llm.fingerprints import PIECE, code_points, edited_with_next, fingerprint_column, gram_hashes, winnow


def plain(text: str, k: int, window: int):
    points = code_points(text)
    if not len(points):
        return []
    k = min(k, len(points))
    h = (gram_hashes(points, k) >> np.uint64(32)).tolist()
    w = min(window, len(h))
    picks = {max((-h[j], j) for j in range(i, i + w))[1] for i in range(len(h) - w + 1)}
    return sorted((j, h[j]) for j in picks)


def test_grams_hash_by_content():
    points = code_points("abcabcabc")
    for k in (1, 2, 3, 5, 7):
        h = gram_hashes(points, k)
        assert len(h) == 9 - k + 1 and all((h[i] == h[j]) == (points[i : i + k].tolist() == points[j : j + k].tolist()) for i in range(len(h)) for j in range(len(h)))


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh é漢😀", "a"])
def test_winnow(alphabet):
    rng = random.Random(8)
    for n in (0, 1, 3, 10, 64, 65, 200):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        positions, hashes = winnow(code_points(text), 5, 9)
        assert list(zip(positions.tolist(), hashes.tolist())) == plain(text, 5, 9)


def test_pieces_of_a_long_text_join(monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice("abcd") for _ in range(3000))
    whole = winnow(code_points(text), 5, 9)
    monkeypatch.setattr("panelweave.llm.fingerprints.PIECE", 100)
    parts = winnow(code_points(text), 5, 9)
    assert PIECE > 3000 and all((a == b).all() for a, b in zip(whole, parts))


def test_shared_runs_are_seen():
    rng = random.Random(10)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = make(64)
    a, b = winnow(code_points(make(500) + shared + make(300))), winnow(code_points(make(90) + shared + make(700)))
    assert set(a[1].tolist()) & set(b[1].tolist())


def test_next_document(spark):
    rng = random.Random(11)
    texts = {i * 3: "".join(rng.choice("abc dé漢😀") for _ in range(rng.choice([0, 1, 3, 50, 400]))) for i in range(60)}
    texts[9] = None
    rows = [(i, t, "clash") for i, t in texts.items()]
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in edited_with_next(spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string")).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    prints = {}
    for i, j in zip(ids, [*ids[1:], ids[0]]):
        mine, after = texts[i] or "", texts[j] or ""
        q = len(mine) // 4
        edited = mine[: len(mine) - q] + after[:q]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(mine), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (edited != mine) or (r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"])
        prints.setdefault(mine, set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


@pytest.mark.parametrize("rows", [[], [(5, "only one here")], [(None, "a"), (None, "b"), (1, "c"), (1, "c"), (1, "b")]])
def test_small_and_repeated(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = edited_with_next(df).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    assert fingerprint_column(df).count() == len(rows)
