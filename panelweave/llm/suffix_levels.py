"""Removal of long repeated passages with a logarithmic family of suffix indexes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.corpus import apart, discard, release, settled
from panelweave.llm.fingerprints import gram_hashes
from panelweave.llm.texts import blocks, utf8

GRAM = 16  # bytes whose hash picks the indexed suffixes
BATCHES = 4
WINDOW = 108  # suffixes of which one is indexed: about one in 54
TOGETHER = 16  # neighbouring strings that are first looked at by what they share
_PLACE = np.uint64((1 << 28) - 1)


@dataclass(frozen=True)
class Shape:
    """How suffixes are picked for matches of ``length`` bytes.

    Of every ``window`` suffixes in a row the one with the least gram hash is indexed (the
    leftmost among ties), by its first ``head`` bytes. Since window - 1 + head is at most
    ``length``, two equal strings of ``length`` bytes find the same suffix in their first window,
    whole head included, wherever they stand.
    """

    length: int

    @property
    def head(self) -> int:
        return max(GRAM, self.length * 32 // 100)

    @property
    def window(self) -> int:
        return min(self.length - self.head + 1, WINDOW)

    @property
    def together(self) -> int:
        return min(TOGETHER, self.length)


def picked(data: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """The segments of all texts long enough, in text order: text, first place, one past the last
    place where a string of ``length`` bytes can begin, and place of the suffix. A segment is a
    run of places whose windows pick the same suffix; towards the end of a text are segments
    where no such string begins (their end is their first place)."""
    sizes = np.diff(offsets)
    room = np.where(sizes >= shape.length, sizes - shape.window - shape.head + 2, 0)
    total = int(room.sum())
    if not total:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    text = np.repeat(np.arange(len(sizes)), room)
    begin = np.arange(total) - np.repeat(np.cumsum(room) - room, room) + offsets[text]
    hashes = gram_hashes(data, GRAM)
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    reach = 1
    while reach * 2 <= shape.window:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < shape.window:
        gap = shape.window - reach
        least = np.minimum(least[:-gap], least[gap:])
    at = (least[begin] & _PLACE).astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], total) - 1
    base = offsets[text[first]]
    start = begin[first] - base
    end = np.maximum(np.minimum(begin[last] + 1 - base, sizes[text[first]] - shape.length + 1), start)
    return text[first], start, end, at[first] - base


def suffixes(docs: DataFrame, shape: Shape, batches: int) -> DataFrame:
    """The indexed suffixes of all texts: id and checksum of the text, hash of the head, the
    segment that picks the suffix, and the hash of all strings that begin in it."""
    rows = docs.select("_id", "_crc", "text", F.pmod(F.xxhash64("_id", "_crc"), F.lit(batches)).cast("int").alias("batch"))
    names = ["_id", "_crc", "batch", "head", "begin", "end", "whole"]

    def index(blocks_of) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in blocks(blocks_of):
            data, offsets = utf8(batch.column("text"))
            text, begin, end, place = picked(data, offsets, shape)
            if not len(text):
                continue
            view, base = memoryview(np.ascontiguousarray(data)), offsets[text]
            heads = np.array([digest(view[a : a + shape.head]) for a in (base + place).tolist()], np.uint64).view(np.int64)
            runs = zip((base + begin).tolist(), (base + end + shape.length - 1).tolist(), (end > begin).tolist())
            wholes = np.array([digest(view[a:b], 1) if some else 0 for a, b, some in runs], np.uint64).view(np.int64)
            taken = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(taken) for c in ("_id", "_crc", "batch")), pa.array(heads), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(wholes)], names=names
            )

    return rows.mapInArrow(index, "_id bigint, _crc bigint, batch int, head bigint, begin int, end int, whole bigint")


@dataclass
class SuffixLevels:
    """Sorted arrays of suffix heads, of geometrically growing size.

    A new batch becomes an array of its own, is merge-scanned against every level, and then
    takes its place: as long as a level of the same rank exists, the two merge into one of the
    next rank. So n batches leave log n levels, and each head moves log n times.

    Suffixes are ordered by a 64-bit hash of their head (a suffix array up to the order of the
    heads); a false match costs a comparison later, never a removed byte.
    """

    levels: dict[int, DataFrame] = field(default_factory=dict)

    def discard(self) -> None:
        """Remove the files of all levels."""
        discard(*self.levels.values())
        self.levels = {}

    def add(self, batch: DataFrame) -> DataFrame:
        """Index a batch (column ``head``). Returns the heads that it repeats, in itself or from
        earlier batches, one row each."""
        array = settled(batch.groupBy("head").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("head"), "suffix-array")
        found = array.filter("n > 1").select("head")
        for level in self.levels.values():
            found = found.unionByName(array.join(level, "head").select("head"))
        found = settled(found.distinct(), "suffix-matches")
        rank = 0
        while rank in self.levels:
            level = self.levels.pop(rank)
            merged = settled(array.unionByName(level).groupBy("head").agg(F.sum("n").alias("n")).sortWithinPartitions("head"), "suffix-level")
            discard(array, level)
            array = merged
            rank += 1
        self.levels[rank] = array
        return found


def flat(lists: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The structs in a column of lists: row of each, and each field as an array."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    values = lists.flatten()
    fields = {f.name: values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(values.type)}
    return np.repeat(np.arange(len(sizes)), sizes), fields


def covered(base: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a run from begin to end - 1, both counted from base."""
    some = end > begin
    steps = np.bincount((base + begin)[some], minlength=n) - np.bincount((base + end)[some], minlength=n)
    return np.cumsum(steps) > 0


MADE = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def cut_repeats(docs: DataFrame, length: int, batches: int = BATCHES, keep_text: bool = False) -> DataFrame:
    """Cut every byte that a string of ``length`` bytes covers which also begins anywhere else.

    Texts are UTF-8 bytes; a null text is empty; strings do not cross documents, may overlap,
    and are judged on the input. Adds n_bytes, n_removed, n_spans (maximal cut runs),
    kept_sha256 and, with ``keep_text``, kept_text (a character that a cut splits goes whole)
    to the other columns; columns of these names are replaced. Repeated rows, equal ids
    included, are repeats of each other.

    1. The documents come in ``batches`` to the index family, which returns all repeated heads.
       A string of ``length`` bytes can only be repeated where the head of its segment is.
    2. A segment whose strings as a whole stand elsewhere is repeated throughout: counted by
       hash, one row per segment, however many copies there are.
    3. Other segments with a repeated head hold the ends of repeats. Their strings are counted
       together with those of one copy of each repeated segment that has the same head; a string
       that runs over a head that is not repeated needs no count. First TOGETHER neighbours are
       counted as one, by the bytes that all of them hold: where these stand nowhere else, none of
       the strings does. Equal strings lie alike around their suffix, so blocks that are counted
       from the suffix meet. What is left is counted by a 128-bit hash of each string. No pair of
       places is ever formed.
    """
    return apart(docs, ["doc_id", "text"], lambda d: _cut_repeats(d, length, batches, keep_text), MADE)


def _cut_repeats(docs: DataFrame, length: int, batches: int, keep_text: bool) -> DataFrame:
    shape, made = Shape(length), MADE
    stay = [c for c in docs.columns if c not in made and (keep_text or c == "doc_id")]
    # keys without nulls: a null id has its own checksum range
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")) + F.when(F.col("doc_id").isNull(), F.lit(1 << 33)).otherwise(F.lit(0))
    keyed = docs.select(*stay, *([] if "text" in stay else ["text"]), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("_id"), F.coalesce(crc, F.lit(0)).cast("bigint").alias("_crc"))
    keys = ["_id", "_crc"]

    table = settled(suffixes(keyed, shape, batches), "suffixes")
    family, found = SuffixLevels(), []
    for i in range(batches):
        found.append(family.add(table.filter(F.col("batch") == i)))
    family.discard()
    heads = found[0]
    for f in found[1:]:
        heads = heads.unionByName(f)
    heads = settled(heads.distinct(), "heads")
    discard(*found)
    parts = []
    for i in range(batches):  # a part of the table is shuffled at a time, and once
        parts.append(settled(table.filter(F.col("batch") == i).drop("batch").join(heads, "head", "left_semi"), "suspects"))
        release(docs.sparkSession)
    discard(table, heads)
    suspects = parts[0]
    for part in parts[1:]:
        suspects = suspects.unionByName(part)
    one = F.struct("_id", "_crc", "begin")
    repeated = suspects.filter("end > begin").groupBy("head", "whole").agg(F.count(F.lit(1)).alias("copies"), F.min(one).alias("one")).filter("copies > 1").drop("copies")
    marked = suspects.join(repeated, ["head", "whole"], "left").select(
        *keys, "head", "begin", "end", (F.col("one").isNotNull() & (F.col("end") > F.col("begin"))).alias("repeated"), F.coalesce(F.col("one") == one, F.lit(False)).alias("chosen")
    )
    marked = settled(marked, "marked")
    discard(*parts)
    opened = marked.filter("NOT repeated AND end > begin").select("head").distinct().withColumn("open", F.lit(True))
    marks = settled(marked.join(opened, "head", "left").select(*keys, "begin", "end", "repeated", (F.col("open").isNotNull() & (~F.col("repeated") | F.col("chosen"))).alias("open")), "marks")
    discard(marked)
    per_text = marks.groupBy(*keys).agg(F.collect_list(F.struct("begin", "end", "open")).alias("marks"))

    def edge_blocks(batches_of) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches_of):
            data, offsets = utf8(batch.column("text"))
            marked_text, mark = flat(batch.column("marks"))
            text, begin, _, place = picked(data, offsets, shape)
            wide, base = len(data) + 1, offsets[text]
            wanted = covered(offsets[marked_text[mark["open"]]], mark["begin"][mark["open"]], mark["end"][mark["open"]], wide)
            # no string that holds a window of another segment, head included, is repeated
            other = ~np.isin(base + begin, offsets[marked_text] + mark["begin"])
            follows = np.append(text[1:] == text[:-1], False)[: len(text)]
            to = np.where(follows, np.append(begin[1:], 0)[: len(text)], (offsets[1:] - offsets[:-1])[text])
            wanted &= ~covered(base[other], np.maximum(0, begin + shape.window - 1 + shape.head - length)[other], to[other], wide)
            at = np.flatnonzero(wanted)
            if not len(at):
                continue
            segment = np.searchsorted(base + begin, at, side="right") - 1
            after = (base + place)[segment] - at
            first = at + after % shape.together  # the last place where a string of the block can begin
            runs = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            masks = np.bitwise_or.reduceat(np.left_shift(1, first - at), runs)
            yield hashed(batch, data, offsets, text[segment[runs]], first[runs], length - shape.together + 1, first=first[runs] - offsets[text[segment[runs]]], mask=masks)

    def edge_strings(batches_of) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches_of):
            data, offsets = utf8(batch.column("text"))
            text, block = flat(batch.column("blocks"))
            row, back = np.nonzero(block["mask"][:, None] >> np.arange(shape.together) & 1)
            at = np.unique((offsets[text] + block["first"])[row] - back)
            text = np.searchsorted(offsets, at, side="right") - 1
            for i in range(0, len(at), 50_000):
                part, of = at[i : i + 50_000], text[i : i + 50_000]
                yield hashed(batch, data, offsets, of, part, length, begin=part - offsets[of])

    def hashed(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, text: np.ndarray, at: np.ndarray, size: int, **columns: np.ndarray) -> pa.RecordBatch:
        view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
        hashes = np.frombuffer(b"".join([digest(view[a : a + size]) for a in at.tolist()]), "<i8").reshape(-1, 2)
        arrays = [*(batch.column(c).take(pa.array(text)) for c in keys), *(pa.array(c, pa.int32()) for c in columns.values()), pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy())]
        return pa.RecordBatch.from_arrays(arrays, names=[*keys, *columns, "h1", "h2"])

    def repeats(counted: DataFrame) -> DataFrame:
        twice = counted.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2")
        return counted.join(twice, ["h1", "h2"], "left_semi")

    edge_rows = keyed.join(per_text, keys).select(*keys, "text", "marks").mapInArrow(edge_blocks, "_id bigint, _crc bigint, first int, mask int, h1 bigint, h2 bigint")
    edge_rows = settled(edge_rows, "blocks")
    release(docs.sparkSession)
    left = settled(repeats(edge_rows).groupBy(*keys).agg(F.collect_list(F.struct("first", "mask")).alias("blocks")), "blocks-left")
    discard(edge_rows)
    edges = settled(keyed.join(left, keys).select(*keys, "text", "blocks").mapInArrow(edge_strings, "_id bigint, _crc bigint, begin int, h1 bigint, h2 bigint"), "edges")
    discard(left)
    at_edges = repeats(edges).select(*keys, "begin", (F.col("begin") + 1).alias("end"))
    cuts = marks.filter("repeated").select(*keys, "begin", "end").unionByName(at_edges)
    per_text_cuts = settled(cuts.groupBy(*keys).agg(F.collect_list(F.struct("begin", "end")).alias("_cuts")), "cuts")
    discard(marks, edges)

    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.select(*stay).schema]
        + ["n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"] + ["kept_text string"] * keep_text
    )

    def cut(batches_of) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches_of):
            column = batch.column("text")
            data, offsets = utf8(column)
            text, run = flat(batch.column("_cuts"))
            gone = covered(offsets[text], run["begin"], run["end"] - 1 + length, len(data) + 1)[:-1]
            inside = np.ones(len(data), bool)
            inside[offsets[:-1][offsets[:-1] < len(data)]] = False
            turns = np.flatnonzero(inside[1:] & (gone[1:] != gone[:-1])) + 1
            before = np.append(0, np.cumsum(gone))[offsets]
            begins = np.append(0, np.cumsum(gone & ~(inside & np.append(False, gone[:-1])[: len(gone)])))[offsets]
            split = np.bincount(np.searchsorted(offsets, turns[(data[turns] & 0xC0) == 0x80], side="right") - 1, minlength=len(offsets) - 1) > 0
            left, bounds = data[~gone].tobytes(), (offsets - before).tolist()
            rests = [left[a:b] for a, b in zip(bounds, bounds[1:])]
            columns = [pa.array(np.diff(offsets)), pa.array(np.diff(before)), pa.array(np.diff(begins)), pa.array([hashlib.sha256(x).hexdigest() for x in rests], pa.string())]
            if keep_text:
                for i in np.flatnonzero(split).tolist():  # a character is cut in two: what is left of it goes
                    a, b = offsets[i], offsets[i + 1]
                    pieces = np.split(data[a:b], turns[(turns > a) & (turns < b)] - a)
                    rests[i] = b"".join(x.tobytes().decode("utf-8", "ignore").encode() for x in pieces[int(gone[a]) :: 2])
                null = column.is_null().to_numpy(zero_copy_only=False).tolist()
                columns.append(pa.array([None if no else x for x, no in zip(rests, null)], pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in stay), *columns], names=[*stay, *made[: 4 + keep_text]])

    joined = keyed.join(per_text_cuts, keys, "left")
    return joined.select(*stay, *([] if "text" in stay else ["text"]), "_cuts").mapInArrow(cut, schema)
