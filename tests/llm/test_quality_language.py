"""Importance resampling and the byte network."""

from __future__ import annotations

import functools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelweave.llm import language, quality

WORDS = {"xx": "alpha beta gamma delta".split(), "yy": "uno dos tres cuatro".split()}


def docs(n=240):
    rng = random.Random(2)
    out = []
    for i in range(n):
        lang = "xx" if i % 3 else "yy"
        words = [rng.choice(WORDS[lang]) for _ in range(rng.randint(5, 80))]
        if i % 10 == 9:
            words = [f"{w}***" for w in words]
        elif i % 10 == 8:
            words = [w for w in words for _ in range(6)]
        out.append((i, " ".join(words), lang, "clash"))
    return out


def test_junk_is_rejected_and_good_text_kept(spark):
    rows = docs()
    df = spark.createDataFrame([*rows, (1000, None, None, "c"), (1001, "", "xx", "c"), (None, "alpha beta", "xx", "c")], "doc_id bigint, text string, lang string, keep string")
    labels = spark.createDataFrame([(i, int(i % 10 < 8), 0) for i in range(0, 240, 2)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.importance_sample(df, labels).collect()
    kept = {r["doc_id"] for r in got if r["keep"]}
    assert len(got) == 243 and {1000, 1001, None} <= kept
    good, junk = {i for i in range(240) if i % 10 < 8}, {i for i in range(240) if i % 10 >= 8}
    assert good <= kept and len(kept & junk) <= 2
    weights = {r["doc_id"]: r["log_weight"] for r in got}
    assert weights[1000] == weights[1001] == 0


@functools.cache
def bucket(gram, at):
    """Where a text of one n-gram is counted; its words come first, its runs last."""
    return int(quality.features(pa.array([gram]))[0][at])


def plain_grams(text):
    """N-grams of the three bags, by plain loops: words, runs of three bytes (both as their buckets), shapes of repeats."""
    words = text.split()
    repeat = [int(i > 0 and words[i] == words[i - 1]) for i in range(len(words))]
    shapes = [tuple(repeat[i - b] if i >= b else 0 for b in range(3)) for i in range(len(words))]
    return [bucket(w, 0) for w in words], [bucket(text[i : i + 3], -1) for i in range(len(text) - 2)], shapes


def test_log_weights_are_those_of_plain_counts(spark):
    """By counting: one language, so that the target model is the labelled texts alone."""
    rows = [(i, t) for i, t, *_ in docs(60)]
    labels = [(i, int(i % 10 < 8)) for i in range(0, 60, 2)]
    good = {i for i, q in labels if q}
    ratios = []
    for bag, added in enumerate(quality.ADDED):
        raw = Counter(g for _, t in rows for g in plain_grams(t)[bag])
        target = Counter(g for i, t in rows if i in good for g in plain_grams(t)[bag])
        size, all_raw = sum(target.values()), sum(raw.values())
        ratios.append({g: math.log((target[g] + added) / (n * size / all_raw + added)) for g, n in raw.items()})
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = quality.importance_sample(df, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    weights = {r["doc_id"]: r["log_weight"] for r in got}
    for i, t in rows:
        want = sum(ratios[bag][g] for bag in range(3) for g in plain_grams(t)[bag])
        assert abs(weights[i] - want) < 1e-3 + 1e-4 * abs(want)


def test_the_draw_decides_among_equal_weights(spark):
    rows = [(i, "alpha beta gamma", "xx") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(200)], "doc_id bigint, quality int")
    got = quality.importance_sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), labels).collect()
    kept = [r["doc_id"] for r in got if r["keep"]]
    assert len({r["log_weight"] for r in got}) == 1
    assert len(kept) == 200 and 150 < sum(kept) / len(kept) < 250


def test_good_documents_are_counted_by_stratum(spark):
    # two strata: of 100 heavy rows 10 are labelled, 9 good; of 300 light ones 30, 6 good; 5 rows of a stratum without labels
    rows = [(i, 50.0) for i in range(100)] + [(i, -50.0) for i in range(100, 400)] + [(400 + i, 0.5) for i in range(5)]
    labels = [(i, int(i > 0)) for i in range(10)] + [(100 + i, int(i < 6)) for i in range(30)] + [(None, 1), (5, 1), (7, None), (999, 1)]
    scored = spark.createDataFrame(rows, "doc_id bigint, log_weight double")
    told = spark.createDataFrame(labels, "doc_id bigint, quality int")
    assert quality.good_count(scored, told) == math.ceil(100 * 0.9 + 300 * 0.2 + 5 * 0.9)
    assert quality.good_count(scored, told.limit(0)) == 405 and quality.good_count(scored.limit(0), told) == 0


def test_k_largest_keys_are_the_sample(spark):
    df = spark.createDataFrame(docs(60), "doc_id bigint, text string, lang string, x string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 3)], "doc_id bigint, quality int, toxic int")
    got = quality.importance_sample(df, labels, k=25).collect()
    top = sorted(got, key=lambda r: -r["gumbel_key"])[:25]
    assert {r["doc_id"] for r in got if r["keep"]} == {r["doc_id"] for r in top}
    again = quality.importance_sample(df, labels, k=25).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert not any(r["keep"] for r in quality.importance_sample(df, labels, k=0).collect())


def test_no_labels_and_empty_tables(spark):
    df = spark.createDataFrame(docs(20), "doc_id bigint, text string, lang string, x string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["log_weight"] for r in quality.importance_sample(df, labels).collect()} == {0.0}
    assert quality.importance_sample(df.limit(0), labels).count() == 0


def test_hashed_grams_stay_in_their_text():
    import pyarrow as pa

    alone = [quality.features(pa.array([t])) for t in ("ab cd", "", "x", "cd cd cd")]
    together = quality.features(pa.array(["ab cd", "", "x", "cd cd cd"]))
    for i, (bucket, _, _) in enumerate(alone):
        assert sorted(bucket) == sorted(together[0][together[1] == i])


def test_languages_are_told_apart(spark):
    rows = docs(300)
    df = spark.createDataFrame([*[(i, t, lang) for i, t, lang, _ in rows], (900, None, "xx"), (901, "12 345 !", "xx"), (902, "", None)], "doc_id bigint, text string, lang string")
    net = language.fit(df, ~language.held_out())
    got = {r["doc_id"]: r for r in language.predict(df, net).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    judged = df.filter(language.held_out() & (F.col("doc_id") < 900)).collect()
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in judged]
    assert len(right) > 50 and np.mean(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    net = language.fit(df, F.lit(True))
    assert net is None and language.predict(df, net).first()["lang_pred"] == "und"
    assert language.predict(df.limit(0), net).count() == 0


def test_windows_cover_every_byte():
    data = np.arange(700, dtype=np.uint16).astype(np.uint8)
    windows, owner = language.cut(data, np.array([0, 0, 300, 700]), 256)
    for i, (a, b) in enumerate([(0, 0), (0, 300), (300, 700)]):
        got = windows[owner == i].reshape(-1)
        assert got[got < 256].astype(np.uint8).tolist() == data[a:b].tolist()


@pytest.mark.parametrize("seed", [0, 1])
def test_training_lowers_the_loss(seed):
    rng = np.random.default_rng(seed)
    windows = rng.integers(97, 110, (80, language.LENGTH)).astype(np.int16)
    labels = np.arange(80) % 2
    windows[labels == 1, 10:40:3] = 120
    net = language.train(windows, labels, ["a", "b"], epochs=20, seed=seed)
    assert (net.log_probabilities(windows).argmax(axis=1) == labels).mean() > 0.95
