"""Filter interactions: every order by brute force, ties, nulls, fields that do not overflow."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import pytest

from panelweave.llm import filter_audit

SCHEMA = "doc_id bigint, text string, lang string, mask int, part string, digest string, first string"
LABELS = "doc_id bigint, quality int, toxic int, good string"
LONG = " ".join(f"w{i}" for i in range(220))
TEXTS = [None, "", "short text", LONG, LONG + " $", "A" * 40 + " " + LONG, "the " * 300, LONG, "UP " * 250 + "|", " é x " * 210, " \t" + LONG + "\x0b\n"]


def brute(docs, labels):
    good = {i for i, q, _, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, *_ in labels if t == 1 and i is not None}
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows, alone, shapley = Counter(), Counter(), Counter()
    parts = set()
    for i, text, lang, *_ in docs:
        text, part = text or "", lang or ""
        parts.add(part)
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and least[text] < i,
        }
        if sum(fails.values()) == 1:
            alone[part, next(f for f in fails if fails[f])] += 1
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                here = fails[f] and not gone
                if fails[f] and gone:
                    rows[part, order, step, "redundant"] += 1
                gone = gone or fails[f]
                if here:
                    rows[part, order, step, "removed"] += 1
                    shapley[part, f] += 1
                    rows[part, order, step, "good_lost"] += i in good
                    rows[part, order, step, "toxic_lost"] += i in toxic
                if not gone:
                    rows[part, order, step, "kept"] += 1
    return {
        (p, o, s): (*[rows[p, o, s, k] for k in ("kept", "removed", "redundant")], alone[p, o[s - 1]], *[rows[p, o, s, k] for k in ("good_lost", "toxic_lost")], shapley[p, o[s - 1]])
        for p in parts for o in map("".join, itertools.permutations("ABCDE")) for s in range(1, 6)
    }


def answer(spark, docs, labels):
    out = filter_audit.audit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS))
    return {tuple(r[:3]): tuple(r[3:]) for r in out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}


def test_equals_brute_force(spark):
    extra = (7, "clash", "clash", "clash")
    docs = [(i if i % 9 else None, TEXTS[i % len(TEXTS)], ["en", None, "", "fr"][i % 4], *extra) for i in range(60)]
    docs += docs[5:12]  # repeated rows are no copies of each other
    labels = [(i, i % 2, i % 3 == 0, "clash") for i in range(1, 60, 2)] + [(3, None, 1, "clash"), (3, 1, None, "clash"), (None, 1, 1, "clash")]
    labels = [(a, b, None if c is None else int(c), d) for a, b, c, d in labels]
    got = answer(spark, docs, labels)
    assert got == brute(docs, labels) and len(got) == 3 * 600


def test_empty_tables(spark):
    assert answer(spark, [], []) == {}
    one = answer(spark, [(1, LONG, None, 0, "", "", "")], [])
    assert len(one) == 600 and set(one.values()) == {(1, 0, 0, 0, 0, 0, 0)}


@pytest.mark.parametrize("n", [1, 2**31, 2**62 // 600])
def test_fields_never_carry(n):
    """Huge counts of several masks: each field of the sum is the sum of that field."""
    table = filter_audit.packed("AB", 1)
    total = sum(n * table[m] for m in (0, 1, 3, 7))
    rows = {(r.filter_order, r.step): r for r in filter_audit.unpacked(total, "AB", ["lost"]).itertuples()}
    ab1, ab2 = rows["AB", 1], rows["AB", 2]
    assert (ab1.kept, ab1.removed, ab1.redundant, ab1.unique_fails, ab1.lost, ab1.shapley) == (n, 3 * n, 0, n, n, 4 * n)
    assert (ab2.kept, ab2.removed, ab2.redundant, ab2.unique_fails, ab2.lost, ab2.shapley) == (n, 0, 2 * n, 0, 0, 2 * n)


def test_a_part_is_counted_before_it_moves(spark):
    masks = spark.range(10_000).selectExpr("'one' AS part", "CAST(id % 3 AS INT) AS mask")
    rows = filter_audit.interactions(masks).filter("filter_order = 'ABCDE' AND step = 1").collect()
    assert rows[0]["removed"] == 3333 and rows[0]["kept"] == 6667
