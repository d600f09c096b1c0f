"""Sharding along a Hilbert curve over metadata, in SQL functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.corpus import numbered, settled

BITS = 5


def size_level(size: Column, bits: int = BITS) -> Column:
    """Number of binary digits of a size: one level per doubling."""
    return F.least(F.length(F.bin(size)), F.lit((1 << bits) - 1)).cast("long")


def value_levels(df: DataFrame, column: str, rows: int, bits: int = BITS) -> DataFrame:
    """Level of each value of a column: the share of rows with a smaller value, in steps of
    2^-bits. The levels keep the order of the values, so files keep narrow value ranges.
    ``rows`` is the row count. The table has a row per distinct value; null comes first."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_rows"))
    summed = numbered(counts, [F.col(column).asc_nulls_first()], "_smaller", weight="_rows")
    level = F.expr(f"(_smaller * {1 << bits}) div {max(rows, 1)}")
    return summed.select(F.col(column), level.alias(f"{column}_level"))


def hilbert_index(levels: Sequence[Column], bits: int = BITS) -> Column:
    """Index along the Hilbert curve of a point with ``bits`` bits per dimension.

    The coordinates are transposed to curve order by the usual exchange and inversion of low
    bits from the highest bit down, then Gray-decoded; here each step is a let-binding
    (``transform`` over an array of one struct), so the expression grows by its steps only.
    """
    names = [f"x{i}" for i in range(len(levels))]
    state = F.struct(*[c.cast("long").alias(n) for c, n in zip(levels, names)])

    def bind(value: Column, step) -> Column:
        return F.transform(F.array(value), step)[0]

    def low_bits(i: int, q: int):
        """Invert the low bits of the first coordinate, or exchange them with coordinate i."""
        p = q - 1

        def step(s: Column) -> Column:
            mine, first = s[names[i]], s["x0"]
            high = mine.bitwiseAND(F.lit(q)) != 0
            swap = first.bitwiseXOR(mine).bitwiseAND(F.lit(p))
            new = {n: s[n] for n in names}
            new["x0"] = F.when(high, first.bitwiseXOR(F.lit(p))).otherwise(first.bitwiseXOR(swap))
            if i:
                new[names[i]] = F.when(high, mine).otherwise(mine.bitwiseXOR(swap))
            return F.struct(*[new[n].alias(n) for n in names])

        return step

    def gray(s: Column) -> Column:
        out, last = [s["x0"]], s["x0"]
        for n in names[1:]:
            last = s[n].bitwiseXOR(last)
            out.append(last)
        return F.struct(*[c.alias(n) for c, n in zip(out, names)])

    def flips(s: Column) -> Column:
        t: Column = F.lit(0).cast("long")
        for k in range(bits - 1, 0, -1):
            t = F.when(s[names[-1]].bitwiseAND(F.lit(1 << k)) != 0, t.bitwiseXOR(F.lit((1 << k) - 1))).otherwise(t)
        return F.struct(*[s[n].bitwiseXOR(t).alias(n) for n in names])

    def interleave(s: Column) -> Column:
        index: Column = F.lit(0).cast("long")
        for k in range(bits - 1, -1, -1):
            for n in names:
                index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(s[n], k).bitwiseAND(F.lit(1)))
        return index

    for k in range(bits - 1, 0, -1):
        for i in range(len(names)):
            state = bind(state, low_bits(i, 1 << k))
    for step in (gray, flips, interleave):
        state = bind(state, step)
    return state


def hilbert_shards(docs: DataFrame, shards: int, dimensions: Sequence[str] = ("lang", "source"), bits: int = BITS) -> DataFrame:
    """Deal rows into ``shards`` runs of the Hilbert curve over the size and ``dimensions``.

    Each dimension is quantised to ``bits`` bits: the size (UTF-8 bytes of the text plus 1; a
    null text has none) by doublings, other columns by the share of rows with smaller values.
    Rows sort by curve index, then size, text hash and id; runs of equal row counts (at most
    one apart, law ``rows``) make the shards. Equal texts with equal metadata are neighbours.

    Needs ``doc_id`` and ``text``. Returns doc_id, size, text_crc32, curve, the levels, law,
    shard, slot (from 0 in each shard, in curve order) and grown_shard (null: only the law
    ``key`` has it). Nulls in a dimension sort first; rows that are equal throughout are dealt
    in any order; an empty table gives no rows. The text itself is never shuffled.
    """
    lead = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        *[F.col(d).cast("string").alias(f"d_{d}") for d in dimensions],
    )
    slim = settled(lead, "slim")
    rows = slim.count()
    points, levels = slim, [size_level(F.col("size"), bits)]
    for d in dimensions:
        points = points.join(settled(value_levels(slim, f"d_{d}", rows, bits), "levels"), f"d_{d}", "left")
        # a null value meets no level in the join and has the lowest
        levels.append(F.coalesce(F.col(f"d_{d}_level"), F.lit(0)).cast("long"))
    points = points.withColumn("curve", hilbert_index(levels, bits))
    order = [F.col("curve"), F.col("size"), F.col("text_crc32"), F.col("doc_id").asc_nulls_first()]
    placed = numbered(points, order)
    begin = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", F.expr(f"(position * {shards}) div {max(rows, 1)}"))
        .select(
            "doc_id", "size", "text_crc32", "curve", F.lit("rows").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("position") - begin).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
