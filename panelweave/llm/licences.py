"""Licence scans: a paragraph classifier that templates confirm, in DataFrame functions only."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.corpus import settled

# Short notices of common licences, by family.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("public-domain", "This work has been released into the public domain."),
    ("public-domain", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited."),
]
# What stands around notices, and licences of no known family.
BEFORE = ["", "Copyright (c) 2021 Example Inc.", "(c) 2019 the authors.", "Note:", "The code and the data of this project are free to share."]
AFTER = ["", "See the LICENSE file for details.", "Contact the owner for more.", "Second edition."]
STRANGE = [
    "Licensed under the Example Corporation Community License, version 7.",
    "This work is licensed under the terms agreed with the publisher.",
    "Use of this text is subject to a separate written agreement.",
    "Shared under the open harvest licence.",
    "Released under the Harbour Commons License.",
    "Licensed under the Blue Lantern License, Version 3.0.",
    "This work is licensed under the Northern Archive Public License, version 2.",
    "You may copy this text for private study under the terms of the Reading Room License.",
]

NONE, UNKNOWN = "none", "unknown"
FEATURES = 1 << 14
SAMPLE = 4_000  # bound of the corpus paragraphs for training, and again for calibration
DOCUMENTS = 4  # documents that are read for each sampled paragraph
# A line that ends a sentence, and a line without letter or digit, end a paragraph; other line ends are wraps.
# The pattern begins with the line end, so that nothing is looked at around any other character.
PARAGRAPH_END = "\\n(?:(?<=[.!?\\u3002\\uff01\\uff1f][\"')\\]]{0,2}[ \\t\\r]{0,4}\\n)|(?=[^\\p{L}\\p{N}\\n]*(?:\\n|$)))"
CONFIRMED = 0.6  # share of a template's n-grams that its paragraph has


def word_list(paragraph: Column) -> Column:
    """Lower-case words; empty for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(paragraph, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def word_grams(words: Column) -> Column:
    """Distinct words and pairs of words. ``words`` is used several times: let it be a column."""
    firsts = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(firsts, F.slice(words, 2, 1_000_000_000), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, pairs))


def grams(paragraph: Column) -> Column:
    """Distinct lower-case words and pairs of words; empty for null."""
    return word_grams(word_list(paragraph))


def template_grams(text: str) -> list[str]:
    """``grams`` of a template, worked out on the driver."""
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys([*words, *map(" ".join, zip(words, words[1:]))]))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, number (from 0) and text (``line``) of each paragraph with a letter or digit, of
    whole texts. Wrapped lines are one paragraph: a line end counts only after the end of a
    sentence and beside a line without letters and digits."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", PARAGRAPH_END)).alias("paragraph", "line"))
    return lines.filter(F.col("line").rlike("[\\p{L}\\p{N}]"))


def _rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("family"), F.lit(t).alias("line")) for a, t in rows])))


def best_match(found: Column, family: Column) -> Column:
    """Greatest share of a template's n-grams among those of the family's templates."""
    listed = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(template_grams(t)).alias("grams")) for f, t in TEMPLATES])
    own = F.filter(listed, lambda t: family.isNull() | (t["family"] == family))
    return F.coalesce(F.array_max(F.transform(own, lambda t: F.size(F.array_intersect(t["grams"], found)) / F.size(t["grams"]))), F.lit(0.0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once a row, however many others are made from them: they
    pass a generator, across which the optimiser does not copy expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


@dataclass
class LicenceModel:
    """Logistic regression over hashed n-grams, its classes, and the calibrated least probability
    of a family that is not ``unknown``."""

    model: LogisticRegressionModel
    families: list[str]
    threshold: float

    def scored(self, lines: DataFrame) -> DataFrame:
        """Add grams, family (most probable class but ``none``), its probability, and that of any
        licence at all."""
        spelled = once(once(lines, _words=word_list(F.col("line"))), grams=word_grams(F.col("_words"))).drop("_words")
        hashed = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="_features").transform(spelled)
        got = once(self.model.transform(hashed), _p=vector_to_array("probability")).drop("_features", "probability")
        only = F.slice("_p", 2, len(self.families) - 1)  # the first class is none
        best = F.array_max(only)
        names = F.array(*map(F.lit, self.families[1:]))
        return (
            got.withColumn("probability", best)
            .withColumn("family", F.element_at(names, F.array_position(only, best).cast("int")))
            .withColumn("licence_probability", 1 - F.col("_p")[0])
            .drop("_p")
        )


def drawn(docs: DataFrame, sample: int) -> tuple[DataFrame, DataFrame]:
    """Two samples of at most ``sample`` corpus paragraphs that resemble no template, in two hash
    orders, of about ``DOCUMENTS`` times as many documents, picked by hash. So what the last
    task merges does not grow with the corpus."""
    n = docs.count()
    share = min(1.0, DOCUMENTS * sample / n) if n else 1.0
    parts = []
    for seed in (1, 2):
        some = docs.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
        part = paragraphs(some).orderBy(F.xxhash64("doc_id", "paragraph", F.lit(seed)), "line").limit(sample).select("line")
        parts.append(part.filter(best_match(grams(F.col("line")), F.lit(None).cast("string")) < CONFIRMED))
    return parts[0], parts[1]


def among(lines: DataFrame, notices: list[tuple[str, str]]) -> DataFrame:
    """Each paragraph with one of the notices, dealt by hash, before or after it."""
    listed = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("notice")) for f, t in notices])
    hashed = F.xxhash64("line")
    dealt = lines.withColumn("_n", listed[F.pmod(hashed, F.lit(len(notices))).cast("int")])
    both = F.when(F.pmod(F.shiftright(hashed, 32), F.lit(2)) == 0, F.concat_ws(" ", "line", "_n.notice")).otherwise(F.concat_ws(" ", "_n.notice", "line"))
    return dealt.select(F.col("_n.family").alias("family"), both.alias("line"))


def calibrated(known: Sequence[float], strange: Sequence[float]) -> float:
    """The mark on the probability that tells known notices (above) from strange ones (not above)
    with the fewest errors; the middle of the widest gap among equally good ones."""
    steps = sorted({0.0, 1.0, *known, *strange})
    known, strange = sorted(known), sorted(strange)
    best = None
    for low, high in zip(steps, steps[1:]):
        errors = bisect_right(known, low) + len(strange) - bisect_right(strange, low)
        if best is None or (errors, low - high) < best[0]:
            best = (errors, low - high), (low + high) / 2
    return best[1]


def train(docs: DataFrame, sample: int = SAMPLE) -> LicenceModel:
    """Fit on the templates, alone, with what may stand around them and among paragraphs of a
    bounded sample of the corpus, against those paragraphs by themselves.

    A second sample calibrates the threshold of ``unknown``: templates, and licences of no known
    family, among its paragraphs; the mark makes the fewest errors on the two. Both have at most
    ``sample`` rows each, and of those only two numbers a row come to the driver. An empty corpus
    leaves the templates and the strange licences by themselves.
    """
    spark = docs.sparkSession
    families = [NONE, *sorted({f for f, _ in TEMPLATES})]
    learnt, held = drawn(docs, sample)
    known = _rows(spark, [(f, " ".join(x for x in (b, t, a) if x)) for f, t in TEMPLATES for b in BEFORE for a in AFTER])
    known = known.unionByName(among(learnt, TEMPLATES))
    plain = learnt.select(F.lit(NONE).alias("family"), "line").unionByName(_rows(spark, [(NONE, x) for x in [*BEFORE, *AFTER] if x]))
    number = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    hashed = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(known.unionByName(plain).withColumn("grams", grams(F.col("line"))))
    fit = LogisticRegression(featuresCol="features", labelCol="label", family="multinomial", regParam=0.001, maxIter=40)
    model = fit.fit(settled(hashed.select("features", number.alias("label")), "notices"))
    model.setFeaturesCol("_features").setRawPredictionCol("").setPredictionCol("")
    out = LicenceModel(model, families, 0.0)
    strange = [(UNKNOWN, x) for x in STRANGE]
    trial = among(held, TEMPLATES).unionByName(among(held, strange)).unionByName(_rows(spark, strange)).withColumnRenamed("family", "meant")
    seen = out.scored(trial).filter("meant = 'unknown' OR meant = family").select("probability", "meant").collect()
    out.threshold = calibrated([r[0] for r in seen if r[1] != UNKNOWN], [r[0] for r in seen if r[1] == UNKNOWN])
    return out


def scan(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """Licence notices of all paragraphs of all whole texts.

    A paragraph is a run of lines (see ``paragraphs``), so a wrapped notice is one. It is a notice when its probability of being one is at least a half. It has the
    family that the classifier names, if that is more probable than the calibrated threshold and
    a template of the family confirms it (has ``CONFIRMED`` of its n-grams in the paragraph); any
    other notice is ``unknown``.

    Returns doc_id, paragraph, family, probability, licence_probability, template_match and
    confirmed: no row for other paragraphs, nor for null or empty texts; repeated rows have their
    rows each. Narrow: no shuffle.
    """
    notices = model.scored(paragraphs(docs)).filter("licence_probability >= 0.5")
    match = best_match(F.col("grams"), F.col("family"))
    judged = notices.withColumn("template_match", match).withColumn("confirmed", (F.col("probability") > model.threshold) & (F.col("template_match") >= CONFIRMED))
    return judged.select(
        "doc_id", "paragraph", F.when(F.col("confirmed"), F.col("family")).otherwise(UNKNOWN).alias("family"), "probability", "licence_probability", "template_match", "confirmed"
    )
