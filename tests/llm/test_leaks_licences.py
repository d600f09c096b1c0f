"""Benchmark leaks, licence notices."""

from __future__ import annotations

import random

import numpy as np

from panelweave.llm import licences, semantic_leaks


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert semantic_leaks.lcs_length(a, b) == lcs(a, b)


def test_leaks_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    prose = lambda n: [vocabulary[min(int(rng.expovariate(1 / 200)), 2999)] for _ in range(n)]
    items = [(i, prose(rng.randint(15, 60))) for i in range(12)]
    rows, want = [], set()
    for i in range(150):
        words = prose(rng.randint(30, 300))
        if i % 5 == 0:
            k, item = items[i % 12]
            changed = list(item)
            if i % 10 == 0:  # a paraphrase: every sixth word another one, the answer as it was
                for j in range(2, len(changed) - 5, 6):
                    changed[j] = rng.choice(vocabulary)
            at = rng.randint(0, len(words))
            words[at:at] = changed
            want.add((i, k))
        text = " ".join(words)
        rows.append((i, text.upper() + "!!" if i % 3 == 0 else text, "clash"))
    rows += [(500, None, "c"), (501, "", "c"), (None, " ".join(items[0][1]), "c"), (502, "short", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([*[(k, " ".join(w)) for k, w in items], (None, "x"), (99, None), (98, "")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in semantic_leaks.leaks(df, bench, rank=48).collect()}
    assert got == want | {(None, 0)}
    assert semantic_leaks.leaks(df.limit(0), bench, rank=8).count() == 0
    assert semantic_leaks.leaks(df, bench.limit(0), rank=8).count() == 0


def test_every_pair_that_the_rule_accepts_is_found(spark):
    """By share of kept words, against the longest common subsequence with all passages."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    prose = lambda n: [vocabulary[min(int(rng.expovariate(1 / 200)), 2999)] for _ in range(n)]
    items = {i: prose(rng.randint(15, 60)) for i in range(20)} | {20: prose(3), 21: prose(1)}
    texts, planted = {}, {}
    for i, kept in enumerate([1.0, 0.9, 0.8, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45] * 10):
        item = list(items[i % 20])
        for j in rng.sample(range(len(item) - 4), min(len(item) - 4, round((1 - kept) * len(item)))):
            item[j] = f"x{rng.randint(0, 10**6)}"
        words = prose(rng.randint(30, 120))
        at = rng.randint(0, len(words))
        words[at:at] = item
        texts[i], planted[i] = words, (kept, i % 20)
    want = set()
    for i, t in texts.items():
        for k, item in items.items():
            tails = [j for j in range(len(t)) if t[j : j + len(item[-4:])] == item[-4:]]
            for b in range(0, max(1, 16 * (-(-len(t) // 16) - 1)), 16):
                low, high = max(0, b - len(item)), b + 32 + len(item)
                share = semantic_leaks.lcs_length(item, t[low:high]) / len(item)
                answer = any(low <= j <= high - len(item[-4:]) for j in tails)
                if share >= 0.8 or (share >= 0.5 and answer):
                    want.add((i, k))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items.items()], "item_id bigint, text string")
    rows = semantic_leaks.leaks(docs, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    missed = {}
    for i, (kept, k) in planted.items():
        if (i, k) in want - got:
            missed[kept] = missed.get(kept, 0) + 1
    assert not missed and got == want and len(want) > 60
    assert len(rows) == len(got) and any(r["cosine"] < semantic_leaks.COSINE / 2 for r in rows)


def test_words_are_made_plain_without_a_translation_in_the_plan(spark):
    texts = ["Don't STOP, e-mail: ÄÖ… «naïve» İstanbul", "...", "", None, "(a) b_c  d", "漢字、x; y", "!a", "z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    made = semantic_leaks.tokenised(docs)
    assert "translate" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r["doc_id"]: np.frombuffer(r["words"], np.uint32).tolist() for r in made.collect()}
    for i, text in docs.select("doc_id", semantic_leaks.plain("text").alias("text")).collect():
        raw = (text or "").encode()
        want = (semantic_leaks.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0] >> np.uint64(32)).astype(np.uint32).tolist()
        assert got.get(i, []) == want
    texts_of = [set(x) for x in got.values()]
    weights = semantic_leaks.document_weights(made)
    for word in set().union(*texts_of):
        assert np.isclose(weights[word >> 17], np.log((len(texts_of) + 1) / (sum(word in x for x in texts_of) + 1)))


def test_sums_of_rows():
    rng = np.random.default_rng(5)
    matrix = rng.standard_normal((50, 7)).astype(np.float32)
    sizes = rng.integers(1, semantic_leaks.STRIDE + 1, 1300)
    begins, picks = np.cumsum(sizes) - sizes, rng.integers(0, 50, sizes.sum())
    want = [matrix[picks[a : a + n]].sum(axis=0) for a, n in zip(begins, sizes)]
    assert np.allclose(semantic_leaks.row_sums(matrix, picks, begins), want, atol=1e-5)
    assert semantic_leaks.row_sums(matrix, picks[:0], begins[:0]).shape == (0, 7)


def test_licence_families(spark):
    rng = random.Random(6)
    prose = lambda: " ".join(rng.choice("the of and land sea river stone wind tree light".split()) for _ in range(12)) + "."
    notices = {0: ("mit", "Released under the MIT License."), 7: ("gpl", "This work is licensed under the GNU General Public License, version 3."),
               11: ("cc-by-nc", "Licensed under CC BY-NC 4.0."), 13: ("proprietary", "All rights reserved."), 17: ("apache", "Licensed under the Apache License, Version 2.0.")}
    rows = []
    for i in range(60):
        lines = [prose() for _ in range(4)]
        if i in notices:
            lines.insert(i % 4, notices[i][1])
        rows.append((i, "\n".join(lines), "clash"))
    rows += [(100, None, "c"), (101, "", "c"), (102, "\n\n", "c"), (0, rows[0][1], "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, family string")
    model = licences.train(df)
    got = licences.scan(df, model).collect()
    confirmed = [(r["doc_id"], r["paragraph"], r["family"]) for r in got if r["confirmed"]]
    want = [(i, i % 4, f) for i, (f, _) in notices.items()]
    assert sorted(confirmed) == sorted([*want, (0, 0, "mit")])
    assert all(r["family"] == "unknown" for r in got if not r["confirmed"]) and len(got) <= len(want) + 3
    strange = spark.createDataFrame([(1, "Licensed under the Harvest Guild License, version 9.")], "doc_id bigint, text string")
    assert {r["family"] for r in licences.scan(strange, model).collect()} <= {"unknown"}
    assert licences.scan(df.limit(0), model).count() == 0


WRAPPED = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish and distribute copies of the Software.""",
    "bsd": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:""",
    "gpl": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "lgpl": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
}


def test_wrapped_notices_are_one_paragraph(spark):
    rng = random.Random(9)
    prose = lambda: " ".join(rng.choice("the of and land sea river stone wind tree light".split()) for _ in range(12)) + "."
    rows = [(i, "\n".join(prose() for _ in range(4))) for i in range(100, 160)]
    for i, notice in enumerate(WRAPPED.values()):
        rows.append((i, f"{prose()}\n{notice}\n\n{prose()}\n"))
        rows.append((10 + i, f"Heading\n * \n * " + notice.replace("\n", "\n * ") + "\n *\n" + prose()))
        rows.append((20 + i, prose() + "\n" + notice.replace("\n", "\r\n") + "\r\n\r\n" + prose()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["family"]) for r in licences.scan(df, licences.train(df)).collect()}
    assert got == {(k + i, family) for k in (0, 10, 20) for i, family in enumerate(WRAPPED)}


def test_paragraphs(spark):
    texts = [None, "", "\n\n", "One.\nTwo\nthree!\n\nfour\n--\nfive \u3002\nsix", "a\n \n\nb\"\nc.\"\nd"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [(r["doc_id"], " ".join(r["line"].split())) for r in licences.paragraphs(df).orderBy("doc_id", "paragraph").collect()]
    assert got == [(3, "One."), (3, "Two three!"), (3, "four"), (3, "-- five \u3002"), (3, "six"), (4, "a"), (4, 'b" c."'), (4, "d")]


def test_paragraph_ends_are_sought_at_line_ends_only(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["\n", "\n", ".", "! ", '"', ")", " ", "\t", "\r", "a", "b7", "--", "\u3002"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    # the plain pattern, which looks back from every character
    plain = "(?<=[.!?\\u3002\\uff01\\uff1f][\"')\\]]{0,2}[ \\t\\r]{0,4})\\n|\\n(?=[^\\p{L}\\p{N}\\n]*(?:\\n|$))"
    from pyspark.sql import functions as F

    assert df.filter(~F.split("text", plain).eqNullSafe(F.split("text", licences.PARAGRAPH_END))).count() == 0
    assert licences.PARAGRAPH_END.startswith("\\n")


def test_the_words_of_a_paragraph_are_split_once(spark):
    rows = [(i, f"river stone wind {i}.\nLicensed under CC BY-NC 4.0.") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    plan = licences.scan(df, licences.train(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(") == 1 and plan.count("array_distinct(") == 1


def test_calibrated_mark_has_the_fewest_errors():
    rng = random.Random(4)
    for _ in range(50):
        known = [rng.random() ** 0.5 for _ in range(rng.randint(0, 12))]
        strange = [rng.random() ** 2 for _ in range(rng.randint(0, 12))]
        errors = lambda t: sum(k <= t for k in known) + sum(s > t for s in strange)
        assert errors(licences.calibrated(known, strange)) == min(map(errors, [0.0, *known, *strange]))


def test_template_grams_are_those_of_sql(spark):
    from pyspark.sql import functions as F

    for _, t in licences.TEMPLATES:
        got = spark.range(1).select(licences.grams(F.lit(t)).alias("g")).first()["g"]
        assert sorted(got) == sorted(licences.template_grams(t))
