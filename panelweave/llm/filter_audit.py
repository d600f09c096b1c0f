"""How filters interact: what each would remove at each place of each order, in one pass."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.corpus import settled

FILTERS = "ABCDE"
LOSSES = ("good_lost", "toxic_lost")
FIELD_BYTES = 8  # a row count fits a long, so no field ever carries into the next
SPACE = r"[\x20\x09-\x0D]+"  # fixed values: ASCII white space
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@cache
def orders(filters: str) -> tuple[str, ...]:
    return tuple("".join(p) for p in itertools.permutations(filters))


@cache
def packed(filters: str, n_losses: int) -> tuple[int, ...]:
    """One integer per mask. The low bits of a mask say which filters a row fails, the bits above
    which losses count for it. The integer has a field for every outcome: per order and step
    kept, removed here, redundant (fails, removed before) and each loss; then per filter whether
    it is the only one failed. Adding integers adds all fields at once."""
    n, width = len(filters), 3 + n_losses
    table = []
    for mask in range(1 << (n + n_losses)):
        fields = []
        for order in orders(filters):
            gone = False
            for f in order:
                fails = bool(mask >> filters.index(f) & 1)
                here = fails and not gone
                gone = gone or fails
                lost = [here and bool(mask >> (n + k) & 1) for k in range(n_losses)]
                fields += [not gone, here, fails and not here, *lost]
        failed = mask & ((1 << n) - 1)
        fields += [failed == 1 << i for i in range(n)]
        assert len(fields) == len(orders(filters)) * n * width + n
        table.append(int.from_bytes(b"".join(int(x).to_bytes(FIELD_BYTES, "little") for x in fields), "little"))
    return tuple(table)


def unpacked(total: int, filters: str, losses: Sequence[str]) -> pd.DataFrame:
    """The fields of a sum of packed integers: a row per order and step."""
    n, width, every = len(filters), 3 + len(losses), orders(filters)
    size = (len(every) * n * width + n) * FIELD_BYTES
    fields = np.frombuffer(total.to_bytes(size, "little"), "<i8")
    steps, alone = fields[:-n].reshape(len(every) * n, width), fields[-n:]
    letter = np.array([filters.index(f) for order in every for f in order])
    whole = np.bincount(letter, steps[:, 1], n).astype(np.int64) if steps[:, 1].sum() < 2**53 else np.array([steps[letter == i, 1].sum() for i in range(n)])
    out = {
        "filter_order": np.repeat(every, n),
        "step": np.tile(np.arange(1, n + 1), len(every)),
        "kept": steps[:, 0],
        "removed": steps[:, 1],
        "redundant": steps[:, 2],
        "unique_fails": alone[letter],
        **{name: steps[:, 3 + k] for k, name in enumerate(losses)},
        "shapley": whole[letter],
    }
    return pd.DataFrame(out)


def interactions(masks: DataFrame, filters: str = FILTERS, losses: Sequence[str] = LOSSES) -> DataFrame:
    """Outcomes of every order of the filters, per part.

    ``masks`` has ``part`` (string, not null) and ``mask`` (int): bit i set if the row fails
    filter i, bit ``len(filters) + k`` set if removing it counts for loss k. Equal rows are
    counted before they move, so a part is at most one row per mask, however large it is; the
    sum of their packed integers is unpacked into one row per order and step, zeros included.
    ``shapley`` is the filter's removals over all orders, at any step. No rows give no parts.
    """
    names = tuple(losses)
    longs = ["kept", "removed", "redundant", "unique_fails", *names, "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in longs)

    def add_up(key: tuple, counts: pd.DataFrame) -> pd.DataFrame:
        integers = packed(filters, len(names))
        total = sum(int(n) * integers[m] for m, n in zip(counts["mask"], counts["n"]))
        rows = unpacked(total, filters, names)
        rows.insert(0, "part", key[0])
        return rows.astype({"step": "int32"})

    counts = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("part").applyInPandas(add_up, schema)


def text_flags(text: Column) -> list[Column]:
    """What filters A to D say of a text: few words, repeated words, capitals, odd characters."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * capitals > 3 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part`` and ``mask`` of each document under the five filters.

    A: under 200 words. B: fewer than half of its words distinct. C: over 3 % capitals A-Z.
    D: holds one of ``#$%&*|``. E: its text is that of a smaller doc_id, removed or not. Losses:
    a label row with quality 1, one with toxic 1; several label rows of a document count once.

    A null text is empty, a null lang the part ''. A row without doc_id has no labels and is
    never a copy (nor makes one); repeated rows of the least doc_id of a text are no copies of
    each other. Texts are compared by SHA-256. Other columns are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = sum((F.when(flag, 1 << i).otherwise(0) for i, flag in enumerate(text_flags(F.col("body")))), F.lit(0))
    slim = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("body")).select(
        "doc_id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), bits.alias("bits")
    )
    rows = settled(slim, "masks")
    known = rows.filter("doc_id IS NOT NULL")
    # a copy is told by (text, id), so the rows of a text copied very often do not meet in a task
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    lost = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1 << 5).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1 << 6).otherwise(0)).alias("toxic")
    )
    told = known.join(first, ["digest", "doc_id"], "left").join(lost, "doc_id", "left")
    copy = F.when(F.col("first").isNull(), 1 << 4).otherwise(0)
    none = F.lit(0)
    mask = F.col("bits") + copy + F.coalesce("good", none) + F.coalesce("toxic", none)
    loose = rows.filter("doc_id IS NULL").select("part", F.col("bits").alias("mask"))
    return told.select("part", mask.alias("mask")).unionByName(loose)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return interactions(document_masks(docs, labels))


ORACLE = """
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    firsts AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
    w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
    l AS (SELECT doc_id, bool_or(coalesce(quality, 0) = 1) AS good, bool_or(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
            CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
            || CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * length(w.text) THEN 'C' ELSE '' END
            || CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first_id < w.doc_id THEN 'E' ELSE '' END AS fails
          FROM w JOIN firsts ON firsts.text = w.text LEFT JOIN l ON l.doc_id = w.doc_id),
    h AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
    c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM c a, c b, c, c d, c e
          WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    p AS (SELECT h.*, filter_order, list_min(list_filter([1, 2, 3, 4, 5], lambda i: contains(fails, substr(filter_order, i, 1)))) AS gone_at FROM h, o),
    s AS (SELECT p.*, step, substr(filter_order, step, 1) AS x FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    r AS (SELECT part, filter_order, step, x, sum(CASE WHEN gone_at IS NULL OR gone_at > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone_at = step THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN contains(fails, x) AND gone_at < step THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN gone_at = step AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN gone_at = step AND toxic THEN n ELSE 0 END) AS toxic_lost
          FROM s GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
      CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
      CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r"""
