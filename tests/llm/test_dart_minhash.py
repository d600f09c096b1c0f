"""Signatures against exact similarity, classes against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from panelweave.llm import dart_minhash
from panelweave.llm.corpus import settled
from panelweave.llm.dart_minhash import dart_signatures, near_duplicates, weighted_elements


def shingles(text: str) -> Counter:
    w = text.encode().lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a: Counter, b: Counter) -> float:
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def brute(rows):
    texts = {t for _, t in rows if t is not None}
    bags = {t: shingles(t) for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    listed = sorted(texts)
    for i, a in enumerate(listed):
        for b in listed[:i]:
            if bags[a] and bags[b] and jaccard(bags[a], bags[b]) >= 0.8:
                root[find(a)] = find(b)
    return {t: find(t) for t in texts}


def corpus(rng: random.Random) -> list[tuple[int | None, str | None]]:
    prose = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    texts: list[str | None] = []
    for n in (8, 60, 200):
        base = prose(n)
        for edits in (0, 0, 1, 1, 2, 3, 5, 8, 13):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
            texts.append(" ".join(w))
    line = " ".join(prose(20))
    texts += [line + "\n" + " ".join(prose(100)) for _ in range(12)]
    texts += ["", " \n", "one", "one two", "ONE two", None, None, "a a a a a a a a a a", "a a a a a a a a a", "a a a a a a"]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[0]), (None, None)]


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(5)
    a = [f"w{rng.randint(0, 99)}" for _ in range(300)]
    b = a[:250] + [f"v{i}" for i in range(50)]
    bags = shingles(" ".join(a)), shingles(" ".join(b))
    values, owner, _ = weighted_elements(pa.array([" ".join(a), " ".join(b), "x", "", None]))
    s = dart_signatures(values, owner, 5, 2048)
    assert abs((s[0] == s[1]).mean() - jaccard(*bags)) < 0.05
    top = np.iinfo(np.uint64).max
    assert (s[:3] < top).all() and (s[3:] == top).all()


def test_heavier_sets_keep_the_darts_of_lighter_ones():
    values, owner, _ = weighted_elements(pa.array(["a b c d e f", "a b c d e f a b c d e f"]))
    s = dart_signatures(values, owner, 2, 256)
    assert (s[1] <= s[0]).all()


def test_classes_equal_all_pairs(spark):
    for seed in (1, 2):
        rows = corpus(random.Random(seed))
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, node int, bands string")
        got = near_duplicates(df).collect()
        want = brute(rows)
        keyed = [(i, want[t] if t is not None else ("null", i)) for i, t in rows]
        least = {}
        for i, k in keyed:
            if i is not None:
                least[k] = min(i, least.get(k, i))
        size = Counter(k for _, k in keyed)
        assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == Counter((i, least.get(k), size[k]) for i, k in keyed)


def test_large_family_and_empty_table(spark):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 900)}" for _ in range(120)]
    rows = []
    for i in range(240):
        w = list(base)
        for _ in range(i % 8):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(df).collect()}
    least = {}
    for i, t in rows:
        least.setdefault(want[t], i)
    assert got == {i: least[want[t]] for i, t in rows}
    assert near_duplicates(df.limit(0)).count() == 0


def test_parities_never_say_more_than_differs():
    rng = np.random.default_rng(4)
    for size, moved in [(1, 1), (30, 4), (150, 40), (900, 200), (6000, 900)]:
        a = rng.integers(0, 1 << 63, size).astype(np.uint64)
        b = np.concatenate([a[moved:], rng.integers(0, 1 << 63, moved).astype(np.uint64)])
        x, y = (dart_minhash.parities(v, np.zeros(len(v), np.int64), 1)[0] for v in (a, b))
        told = sum(int(i ^ j).bit_count() if i ^ j >= 0 else 64 - int(~(i ^ j)).bit_count() for i, j in zip(x.tolist(), y.tolist()))
        assert told <= 2 * moved and (size > 200 or told > 0.6 * 2 * moved)


def test_a_family_twice_as_large_makes_no_four_times_the_pairs(spark, monkeypatch):
    """Near copies of one text that are not similar enough to each other never become rows."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = rng.choices(vocabulary, k=150)
    counted = {}
    for n in (60, 120):
        rows = []
        for i in range(n):
            words = list(base)
            for at in rng.sample(range(150), 4):  # similarity to the base near 0.77, to each other near 0.6
                words[at] = rng.choice(vocabulary)
            rows.append((i, " ".join(words)))
        made = {}
        monkeypatch.setattr(dart_minhash, "settled", lambda df, name, keep=made: keep.setdefault(name, settled(df, name)) if name == "pairs" else settled(df, name))
        monkeypatch.setattr(dart_minhash, "discard", lambda *frames: None)
        dart_minhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string"))
        counted[n] = made["pairs"].count()
    assert counted[120] < 3 * max(counted[60], 20)
