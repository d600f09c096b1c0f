"""Near-duplicate detection with DartMinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.corpus import apart, discard, settled
from panelweave.llm.graph import components
from panelweave.llm.texts import blocks, mix, occurrences, runs_within, shingles, utf8, words

SHINGLE = 5  # words
SIMILARITY = 0.8
BANDS, ROWS = 32, 5  # a pair at similarity 0.8 shares no band with probability (1 - 0.8^5)^32 = 3e-6
SKETCH_BITS = 1024  # parities of the elements of a text, by hash
_POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800)])


def weighted_elements(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements of unit weight of each text: its word shingles, the second and later occurrence
    of one as elements of their own. An integer weight is a stack of unit regions, so sets of
    these elements compare as weighted sets. Sorted by text; also the bounds of each text."""
    data, offsets = utf8(column)
    hashes, owner = words(data, offsets)
    values, owner = shingles(hashes, owner, len(offsets) - 1, size)
    values, owner = occurrences(values, owner)
    return values, owner, runs_within(owner, len(offsets) - 1)


def dart_signatures(values: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signature of each weighted set: per coordinate the rank of its earliest dart.

    The plane of (element, rank) is cut into unit cells, and a hash of the cell decides how many
    darts hit it (Poisson of mean 1), at what rank, and for which coordinate. Sets that share
    an element thus share its darts. A set of total weight W looks at ranks below t / W, which
    meets t darts on average whatever its size; should a coordinate stay empty, it looks twice
    as far. Sets without elements have all coordinates at the greatest value.
    """
    best = np.full((n, k), np.iinfo(np.uint64).max, np.uint64)
    weight = np.bincount(owner, minlength=n)
    reach = (k * np.log(k) + 2 * k) / np.maximum(weight, 1)
    open_ = weight > 0
    while open_.any():
        use = open_[owner]
        v, o = values[use], owner[use]
        levels = np.ceil(reach[o]).astype(np.int64)
        cell_v, cell_o = np.repeat(v, levels), np.repeat(o, levels)
        level = np.arange(len(cell_v)) - np.repeat(np.cumsum(levels) - levels, levels)
        cell = mix(cell_v + mix(level.astype(np.uint64) + np.uint64(0x51ED)))
        hits = np.searchsorted(_POISSON, (cell >> np.uint64(11)) * 2.0**-53)
        dart = np.repeat(cell, hits)
        number = np.arange(len(dart)) - np.repeat(np.cumsum(hits) - hits, hits)
        dart = mix(dart + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
        dart_o, dart_level = np.repeat(cell_o, hits), np.repeat(level, hits)
        # rank: the level in the high bits, the place in the cell below
        inside = mix(dart + np.uint64(0xA5A5))
        seen = dart_level + (inside >> np.uint64(11)) * 2.0**-53 < reach[dart_o]
        rank = (dart_level.astype(np.uint64) << np.uint64(44)) | (inside >> np.uint64(20))
        at = dart_o[seen] * k + ((dart[seen] >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
        np.minimum.at(best.reshape(-1), at, rank[seen])
        open_ &= (best == np.iinfo(np.uint64).max).any(axis=1)
        reach = np.where(open_, reach * 2, reach)
    return best


def parities(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per set, for each of ``SKETCH_BITS`` classes of elements whether their number is odd, as longs.

    Where the parities of two sets differ, an element of the class is in one of them only. So the
    sets differ in no fewer elements than their parities do: a bound that never errs.
    """
    at = owner * SKETCH_BITS + (mix(values + np.uint64(0x5EED)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * SKETCH_BITS) & 1).astype(bool)
    return np.packbits(odd.reshape(n, SKETCH_BITS), axis=1).view(np.int64)


def signature_rows(texts: DataFrame, k: int, bands: int, size: int = SHINGLE) -> DataFrame:
    """Per row of (key, text): number of elements, one hash per band, and the parities of its
    elements. Texts without a word have no row."""
    names = ["key", "elements", "bands", "sketch"]

    def sign(batches) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, most=1 << 19):
            values, owner, bounds = weighted_elements(batch.column("text"), size)
            have = np.flatnonzero(np.diff(bounds))
            if not len(have):
                continue
            marks = mix(dart_signatures(values, owner, batch.num_rows, k)[have] + np.arange(k, dtype=np.uint64))
            r = k // bands
            band = np.zeros((len(have), bands), np.uint64)
            for j in range(r):
                band = mix(band + marks[:, j::r][:, :bands])
            sketch = parities(values, owner, batch.num_rows)[have]
            lists = [pa.array(list(x.view(np.int64)), pa.list_(pa.int64())) for x in (band, sketch)]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(have)), pa.array(np.diff(bounds)[have]), *lists], names=names)

    return texts.select("key", "text").mapInArrow(sign, "key string, elements bigint, bands array<bigint>, sketch array<bigint>")


def element_rows(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Per row of (node, text) the elements, as 32-bit hashes."""

    def spell(batches) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            values, _, bounds = weighted_elements(batch.column("text"), size)
            short = (values >> np.uint64(32)).astype(np.uint32).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(short))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "elements"])

    return texts.select("node", "text").mapInArrow(spell, "node bigint, elements array<int>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose exact weighted Jaccard similarity reaches the mark."""
    one = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    other = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    shared = F.size(F.array_intersect("ea", "eb"))
    joined = pairs.select("a", "b").join(one, "a").join(other, "b")
    return joined.filter(shared >= F.lit(similarity) * (F.size("ea") + F.size("eb") - shared)).select("a", "b")


def classes(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Classes of near-duplicate texts: connected components of the pairs whose weighted Jaccard
    similarity over shingles of ``size`` words is at least ``similarity``.

    Equal texts are one node (the MD5 of the text) throughout, whatever their number. The
    nodes of a band bucket are first linked to its most central node, the one with the most
    company over all its bands, and verified; then each bucket compares only nodes that are
    still in different components, and of these only pairs

    * the parities of whose elements differ in no more classes than their elements can, and
    * that could share enough elements: in a large bucket, elements that no other node of any
      large bucket has do not count.

    Both bounds are conditions of the join, so what is discarded is never a row, and neither
    can lose a pair. All remaining pairs are verified exactly.

    Returns doc_id, key (MD5 of the text, null for null) and class (a name) of each row. A text
    without a word is only near its equals; null texts stand alone, but for rows that share an
    id. The shape of the classes does not depend on the order or the partitions of the rows.
    """
    base = docs.select("doc_id", "text", F.md5("text").alias("key"))
    ids = settled(base.select("doc_id", "key"), "ids")
    nodes = settled(
        ids.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("pick")).withColumn("node", F.monotonically_increasing_id()), "nodes"
    )
    signed = signature_rows(base.filter("text IS NOT NULL"), bands * rows, bands, size)
    signs = settled(signed.dropDuplicates(["key"]).join(nodes.select("key", "node"), "key").drop("key"), "signatures")
    buckets = settled(
        signs.select("node", "elements", "sketch", F.posexplode("bands").alias("band", "hash")).select(F.xxhash64("band", "hash").alias("bucket"), "node"), "bands"
    )
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("company")).filter("company > 1")
    crowded = settled(buckets.join(sizes, "bucket"), "crowded")

    central = crowded.groupBy("node").agg(F.sum("company").alias("centre"))
    ranked = crowded.join(central, "node")
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("centre", "node")).alias("top")).select("bucket", F.col("top.node").alias("a"))
    stars = settled(crowded.join(leaders, "bucket").filter("node <> a").select("a", F.col("node").alias("b")).distinct(), "stars")

    # one text per node: by id and key, so that many copies do not meet in one task
    none = F.lit(-1).cast("long")
    wanted = nodes.join(crowded.select("node").distinct(), "node").select("node", F.col("key").alias("_key"), F.coalesce("pick", none).alias("_pick"))
    texts = base.filter("text IS NOT NULL").join(wanted, (F.coalesce("doc_id", none) == F.col("_pick")) & (F.col("key") == F.col("_key")))
    sets = settled(element_rows(texts, size).dropDuplicates(["node"]), "elements")
    first = settled(_verified(stars, sets, similarity), "links")
    label = components(first)

    # what is left: buckets with nodes of several components
    placed = crowded.join(label, "node", "left").select("bucket", "node", "company", F.coalesce("label", "node").alias("label"))
    split = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
    rest = settled(placed.join(split, "bucket", "left_semi"), "split")
    large = rest.filter("company > 50").select("node").distinct()
    own = (
        sets.join(large, "node", "left_semi").select("node", F.explode("elements").alias("element"))
        .groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).filter("n = 1")
        .groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    )
    facts = settled(
        rest.select("node", "label").distinct().join(signs.select("node", "elements", "sketch"), "node").join(own, "node", "left")
        .select("node", "label", "elements", "sketch", (F.col("elements") - F.coalesce("own", F.lit(0))).alias("common")),
        "facts",
    )
    side = rest.select("bucket", "node", "company").join(facts, "node")
    a = side.select(*[F.col(c).alias(f"a_{c}") for c in side.columns])
    b = side.select(*[F.col(c).alias(f"b_{c}") for c in side.columns])
    different = F.lit(0)  # elements that only one of the two has, at least
    for i in range(SKETCH_BITS // 64):
        different = different + F.bit_count(F.col("a_sketch")[i].bitwiseXOR(F.col("b_sketch")[i]))
    share = similarity / (1 + similarity)
    enough = lambda x, y: F.least(x, y) >= F.lit(share) * (F.col("a_elements") + F.col("b_elements")) - 1e-6
    condition = (
        (F.col("a_bucket") == F.col("b_bucket")) & (F.col("a_node") < F.col("b_node")) & (F.col("a_label") != F.col("b_label"))
        & enough(F.col("a_elements"), F.col("b_elements"))
        & ((F.col("a_company") <= 50) | enough(F.col("a_common"), F.col("b_common")))
        & (different <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("a_elements") + F.col("b_elements")) + 1e-6)
    )
    more = a.join(b, condition).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()
    pairs = settled(more, "pairs")
    second = settled(_verified(pairs, sets, similarity), "links")
    links = first.unionByName(second)
    final = components(links) if not second.isEmpty() else label
    discard(signs, buckets, crowded, stars, sets, rest, facts, pairs, first, second)
    named = nodes.join(final, "node", "left").select("key", F.coalesce("label", "node").cast("string").alias("class"))
    lone = F.concat(F.lit("null "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return ids.join(named, "key", "left").select("doc_id", "key", F.coalesce("class", lone).alias("class"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (least doc_id of the class) and class_size (rows) of every row."""
    owned = classes(docs, similarity)
    sizes = owned.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return owned.join(sizes, "class").select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The row of each class with the least doc_id (then key); null ids come last. Of rows with
    equal id and text one stays. Rows keep their columns, whatever their names."""
    return apart(docs, ["doc_id", "text"], lambda d: _one_of_each(d, similarity))


def _one_of_each(docs: DataFrame, similarity: float) -> DataFrame:
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    chosen = classes(docs, similarity).groupBy("class").agg(F.min(order).alias("one")).select(
        F.coalesce("one.doc_id", F.lit(-1).cast("long")).alias("_id"), F.coalesce("one.key", F.lit("")).alias("_key"), F.col("one.doc_id").isNull().alias("_none")
    )
    keyed = docs.withColumns(
        {"_id": F.coalesce("doc_id", F.lit(-1).cast("long")), "_key": F.coalesce(F.md5("text"), F.lit("")), "_none": F.col("doc_id").isNull()}
    )
    keys = ["_id", "_key", "_none"]
    return keyed.join(chosen, keys, "left_semi").dropDuplicates(keys).drop(*keys)
