"""Quality classification by importance resampling over hashed n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.corpus import numbered, settled
from panelweave.llm.texts import blocks, mix, utf8, words

# Three bags of n-grams, each hashed into its own buckets: words, runs of three bytes, and which
# of three neighbouring words repeat the one before.
BUCKETS = (1 << 14, 1 << 15, 1 << 3)
ADDED = (5.0, 5.0, 1.0)  # to the counts of both models, in n-grams of the target
TARGET_ROWS = 20_000  # bound of the labelled sample that stands for the target


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket of each n-gram of the texts, numbered through all bags, and the text it is from."""
    data, offsets = utf8(column)
    hashes, owner = words(data, offsets)
    found = [((hashes >> np.uint64(64 - 14)).astype(np.int64), owner)]
    repeats = np.zeros(len(hashes), np.int64)
    repeats[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    shape = repeats.copy()
    for back in (1, 2):
        # only words of the same text, so that a weight does not depend on the text before
        shape[back:] += (repeats[:-back] << back) * (owner[back:] == owner[:-back]) if len(shape) > back else 0
    found.append((shape + BUCKETS[0] + BUCKETS[1], owner))
    if len(data) > 2:
        wide = data.astype(np.uint32)
        runs = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
        runs = (runs * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)
        sizes = np.diff(offsets)
        inside = np.ones(len(data), bool)
        for back in (1, 2):
            inside[(offsets[1:] - back)[sizes >= back]] = False
        inside = inside[: len(runs)]
        found.append((runs.astype(np.int64)[inside] + BUCKETS[0], np.repeat(np.arange(len(sizes)), np.maximum(sizes - 2, 0))))
    return np.concatenate([f for f, _ in found]), np.concatenate([o for _, o in found]), len(offsets) - 1


def log_ratios(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> np.ndarray:
    """Log of target over raw probability of each bucket.

    The raw model counts the n-grams of all documents. The target model counts those of
    labelled documents of quality 1, the ``target_rows`` that come first by a hash of their id;
    within it each value of ``lang`` (where there is such a column) has the weight it has in
    the raw model, so that languages are neither preferred nor avoided, and one without a
    labelled document counts as it is. Tasks send one row per bucket and language that they
    met; the driver gets one row per bucket.
    """
    wanted = (
        labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).withColumn("_target", F.lit(True))
    )
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    # at most target_rows ids
    marked = (
        docs.select("doc_id", "text", lang.alias("_lang")).join(F.broadcast(wanted), "doc_id", "left")
        .select("text", F.coalesce("_target", F.lit(False)).alias("_target"), "_lang")
    )
    total = sum(BUCKETS)

    def send(lang: str, raw: np.ndarray, target: np.ndarray):
        met = np.flatnonzero(raw)
        for i in range(0, len(met), 20_000):
            part = met[i : i + 20_000]
            columns = [pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(raw[part]), pa.array(target[part])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "raw", "target"])

    def count(batches) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in blocks(batches):
            bucket, owner, n = features(batch.column("text"))
            langs = batch.column("_lang").to_pylist()
            names = sorted(set(langs))
            at = np.array([names.index(x) for x in langs]) * 2 + batch.column("_target").to_numpy(zero_copy_only=False)
            counts = np.bincount(at[owner] * total + bucket, minlength=2 * len(names) * total).reshape(len(names), 2, total)
            for x, c in zip(names, counts):
                held[x] = held[x] + c if x in held else c
            while len(held) > 16:  # a bounded number of languages at a time
                x = next(iter(held))
                c = held.pop(x)
                yield from send(x, c.sum(axis=0), c[1])
        for x, c in held.items():
            yield from send(x, c.sum(axis=0), c[1])

    bag = F.when(F.col("bucket") < BUCKETS[0], 0).when(F.col("bucket") < BUCKETS[0] + BUCKETS[1], 1).otherwise(2)
    counts = settled(
        marked.mapInArrow(count, "lang string, bucket bigint, raw bigint, target bigint").groupBy("lang", "bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")),
        "n-grams",
    ).withColumn("bag", bag)
    sizes = counts.groupBy("lang", "bag").agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    scaled = F.when(F.col("all_target") > 0, F.col("target") * F.col("all_raw") / F.col("all_target")).otherwise(F.col("raw"))
    rows = counts.join(sizes, ["lang", "bag"]).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum(scaled).alias("scaled"), F.sum("target").alias("target"))
    raw, target, seen = np.zeros(total), np.zeros(total), np.zeros(total)
    for r in rows.toLocalIterator():
        raw[r["bucket"]], target[r["bucket"]], seen[r["bucket"]] = r["raw"], r["scaled"], r["target"]
    out, begin = np.zeros(total), 0
    for size, added in zip(BUCKETS, ADDED):
        part = slice(begin, begin + size)
        if seen[part].sum():
            scale = seen[part].sum() / raw[part].sum()
            out[part] = np.log((target[part] * scale + added) / (raw[part] * scale + added))
        begin += size
    return out


def weighed(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """Add ``log_weight`` (sum of the log ratios of all n-grams of the whole text) and
    ``gumbel_key`` (the same plus Gumbel noise that a hash of id and text decides)."""
    stay = [c for c in docs.columns if c not in ("log_weight", "gumbel_key")]
    source = docs.select(*stay)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema] + ["log_weight double"])

    def score(batches) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            bucket, owner, n = features(batch.column("text"))
            # sums in one fixed order, so that equal texts weigh the same
            weight = np.round(np.bincount(owner, weights=ratios[bucket], minlength=n), 6)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight)], names=[*stay, "log_weight"])

    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(11)), 11).cast("double") + 0.5) / float(1 << 53)
    return source.mapInArrow(score, schema).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))


def good_count(scored: DataFrame, labels: DataFrame) -> int:
    """How many of all documents are good, as the labels tell: rows are put into strata of similar
    log weight, and each stratum has the share of quality 1 of its labelled rows (one without any:
    the larger share of its labelled neighbours; no labels at all: 1). Rounded up.

    Ids and qualities that are null say nothing; an id with several labels counts with their mean.
    """
    told = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg((F.col("quality") == 1).cast("double")).alias("_good"))
    stratum = F.floor(F.asinh("log_weight")).alias("stratum")  # some 25 for any weight
    rows = scored.select("doc_id", stratum).join(told, "doc_id", "left").groupBy("stratum")
    strata = rows.agg(F.count(F.lit(1)).alias("n"), F.count("_good").alias("labelled"), F.sum("_good").alias("good")).collect()
    shares = {r["stratum"]: r["good"] / r["labelled"] for r in strata if r["labelled"]}

    def share(at: int) -> float:
        below, above = [s for s in shares if s <= at], [s for s in shares if s >= at]
        return max([shares[s] for s in (max(below, default=None), min(above, default=None)) if s is not None], default=1.0)

    return math.ceil(round(sum(r["n"] * share(r["stratum"]) for r in strata), 6))


def importance_sample(docs: DataFrame, labels: DataFrame, k: int | None = None, target_rows: int = TARGET_ROWS, keep_text: bool = True) -> DataFrame:
    """Mark a sample of ``k`` documents drawn without replacement by importance weight.

    The weight of a document is the ratio of its probability under the target model to that
    under the raw model; the k largest of log weight plus Gumbel noise are the sample. Without
    ``k`` it is ``good_count``, the number of good documents that the labels tell: no weight is a
    mark by itself.

    Adds log_weight, gumbel_key and keep; columns of these names are replaced. Null and empty
    texts have weight 1 (log 0) and stay by it. Ties at the last place all stay. Without target
    labels all weights are 1. Rows and columns of ``docs`` are otherwise untouched; the scored
    rows are settled once (``keep_text=False``: without the text), and only keys are sorted.
    """
    base = docs.select(*[c for c in docs.columns if c != "keep"])
    scores = weighed(base, log_ratios(docs, labels, target_rows))
    scored = settled(scores if keep_text else scores.drop("text"), "weighed")
    if k is None:
        k = good_count(scored, labels)
    keys = scored.select("gumbel_key")
    last = numbered(keys, [F.col("gumbel_key").desc()]).filter(F.col("position") == k - 1).first() if k > 0 else None
    if last is not None:
        keep = F.col("gumbel_key") >= F.lit(last["gumbel_key"])
    else:
        keep = F.lit(k > 0)
    return scored.withColumn("keep", keep)
