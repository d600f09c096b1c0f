"""Document fingerprints by winnowing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.corpus import partitions, settled
from panelweave.llm.texts import mix

K = 16  # code points of a hashed gram
WINDOW = 49  # grams of a window: a shared run of K + WINDOW - 1 = 64 code points is always seen
PIECE = 1 << 18  # code points hashed at a time
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k code points: a polynomial joined from doubled lengths."""
    have, size, total, done = points.astype(np.uint64) + np.uint64(1), 1, None, 0
    power = _BASE
    n = len(points) - k + 1
    while True:
        if k & size:
            part = have[done : done + n]
            total = part.copy() if total is None else total * np.uint64(power) + part
            done += size
        if size * 2 > k:
            return mix(total)
        have = have[:-size] * np.uint64(power) + have[size:]
        power, size = power * power % (1 << 64), size * 2


def winnow(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes: in every window of ``window`` grams the least hash, the
    rightmost one among ties. A text shorter than a window is one window; one shorter than a
    gram is a single gram; an empty text has none."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    k = min(k, n)
    found = []
    step = max(PIECE, 4 * window)
    for begin in range(0, max(n - k + 1 - window, 0) + 1, step):
        part = points[begin : begin + step + window - 1 + k - 1]
        hashes = gram_hashes(part, k) >> np.uint64(32)
        # least hash first, then rightmost: the place counts down in the low bits
        least = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(hashes), dtype=np.uint64))
        wide, reach = min(window, len(hashes)), 1
        while reach * 2 <= wide:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < wide:
            least = np.minimum(least[: len(least) - (wide - reach)], least[wide - reach :])
        least = least[:step]
        if len(least):
            new = np.ones(len(least), bool)
            new[1:] = least[1:] != least[:-1]
            least = least[new]
            found.append(np.stack([np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF)) + np.uint64(begin), least >> np.uint64(32)]))
    both = np.unique(np.concatenate(found, axis=1), axis=1)
    return both[0].astype(np.int64), both[1].astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the hash sets; two empty fingerprints are alike."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    a, b = np.unique(a), np.unique(b)
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def written(positions: np.ndarray, hashes: np.ndarray) -> str:
    """Hex of the 32-bit hashes and their 32-bit positions, in text order."""
    return np.stack([hashes.astype(np.int64), positions], axis=1).astype(">u4").tobytes().hex()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def fingerprint_column(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Add ``positions`` and ``hashes`` of the winnowed grams of ``text`` to the rows.

    Both arrays are empty for a null or empty text. Narrow; columns of these names are replaced.
    """
    stay = [c for c in docs.columns if c not in ("positions", "hashes")]
    source = docs.select(*stay)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema] + ["positions array<bigint>, hashes array<bigint>"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [winnow(code_points(t or ""), k, window) for t in batch.column("text").to_pylist()]
            columns = [pa.array([m[j].astype(np.int64) for m in made], pa.list_(pa.int64())) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*stay, "positions", "hashes"])

    return source.mapInArrow(run, schema)


def with_next(docs: DataFrame, ranges: int) -> tuple[DataFrame, list]:
    """Deal doc_id and text into ranges of ascending doc_id, each followed by a copy of the row
    that comes after it (after the last: the first row of all).

    Range bounds are approximate quantiles of the ids, one number per range. A range with no
    rows is passed over. Returns the rows with ``_range`` and ``_after`` (the copied row).
    """
    cuts = docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] if ranges > 1 else []
    bounds = sorted(set(cuts or []))
    at = F.lit(0) if not bounds else F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("doc_id"))))
    dealt = docs.select("doc_id", "text", at.alias("_range"))
    # the first row of each range, ties by text, null before all: one small row per range
    order = F.struct(F.col("doc_id").isNotNull().alias("a"), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("m"))
    firsts = sorted(dealt.groupBy("_range").agg(F.min(order).alias("first")).collect(), key=lambda r: r["_range"])
    if not firsts:
        return dealt.withColumn("_after", F.lit(False)).limit(0), []
    goes = {b["_range"]: a["_range"] for a, b in zip([firsts[-1], *firsts], firsts)}
    copies = docs.sparkSession.createDataFrame(
        [(r["_range"], r["first"]["doc_id"], r["first"]["m"], goes[r["_range"]]) for r in firsts], "_first int, _id bigint, _m string, _to int"
    )
    return dealt, [copies, firsts]


def edited_with_next(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text, of the text with its last quarter replaced by the beginning
    of the next document's, and how alike they are.

    The next document has the next doc_id, equal ids in order of the MD5 of their text, null ids
    first; the last is followed by the first. Null texts count as empty, and texts without
    code points have an empty fingerprint; two empty ones are alike. One shuffle of the texts,
    by ranges of doc_id; each range also gets a copy of the row after it.
    """
    spark = docs.sparkSession
    dealt, extra = with_next(docs, partitions(spark))
    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, guarantee int"
    )
    if not extra:
        return spark.createDataFrame([], schema)
    copies, firsts = extra
    rows = dealt.withColumn("_m", F.md5(F.coalesce("text", F.lit(""))))
    # one row per range carries its text once more
    follow = (
        rows.join(F.broadcast(copies), (rows["_range"] == F.col("_first")) & rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["_m"] == copies["_m"]))
        .select("doc_id", "text", F.col("_to").alias("_range"), rows["_m"])
        .dropDuplicates(["_range"])
    )
    both = rows.withColumn("_after", F.lit(False)).unionByName(follow.withColumn("_after", F.lit(True)))
    ordered = both.repartition(partitions(spark), "_range").sortWithinPartitions("_range", "_after", F.col("doc_id").asc_nulls_first(), "_m").select("doc_id", "text", "_range", "_after")

    def run(batches) -> Iterator[pa.RecordBatch]:
        def compare(one, other):
            points, following = one[1], other[1]
            cut = len(points) - len(points) // 4
            edited = np.concatenate([points[:cut], following[: len(points) // 4]])
            mine, changed = one[2], winnow(edited, k, window)
            return (
                one[0], len(points), hashlib.sha256(edited.tobytes().decode("utf-32-le").encode()).hexdigest(), written(*mine), written(*changed),
                likeness(mine[1], changed[1]), likeness(mine[1], other[2][1]), k + window - 1,
            )

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]
        names = [c.split()[0] for c in schema.split(", ")]
        held = None
        for batch in batches:
            out = []
            for doc_id, text, part, after in zip(*(batch.column(i).to_pylist() for i in range(4))):
                points = code_points(text or "")
                row = (doc_id, points, winnow(points, k, window), part)
                if held is not None and held[3] == part:
                    out.append(compare(held, row))
                held = None if after else row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return ordered.mapInArrow(run, schema)
