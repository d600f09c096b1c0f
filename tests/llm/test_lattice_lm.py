"""Lattice scores against all segmentations, base scores against counting."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from panelweave.llm.lattice_lm import PieceLattice, held_out, lattice_scores


def enumerate_all(word: bytes, pieces: dict[bytes, list[float]]) -> float:
    if not word:
        return 1.0
    return sum(math.exp(s) * enumerate_all(word[k:], pieces) for k in range(1, len(word) + 1) for s in pieces.get(word[:k], ()))


def test_forward_sums_all_segmentations():
    mark = "▁".encode()
    pieces = {mark: [-3.0], mark + b"a": [-2.0], b"a": [-1.5, -4.0], b"ab": [-2.5], b"b": [-2.2], b"ba": [-3.3], b"aba": [-5.0], mark + b"ab": [-2.9]}
    words = [b"a", b"ab", b"abab", b"b", b"", b"aaaabbbb"]
    got = PieceLattice(pieces).word_scores(words)
    np.testing.assert_allclose(np.exp(got), [enumerate_all(mark + w, pieces) for w in words], rtol=1e-9)


@pytest.mark.parametrize("common", [2, 1000])
def test_scores(spark, common):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    texts = ["The cat\tsat", "the CAT ran ran", None, "", "Élan  élan x", "zq" * 40, "the " * 30] * 4
    rows = [(i if i else None, t, "clash") for i, t in enumerate(texts)] + [(3, "twice", "x"), (3, "twice", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    got = lattice_scores(df, ~held_out(), model, common_words=common).collect()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), "end"]
    counts = Counter(w for i, t, _ in rows if not out(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, _ in rows:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))
        want[(i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(base, 6))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[7] == pytest.approx(score[14]) and score[6] < score[1] < score[2]
    assert lattice_scores(df.limit(0), ~held_out(), model).count() == 0
