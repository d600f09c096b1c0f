"""A Merkle manifest of a table: nested rollup of digests, and a proof for every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.corpus import partitions, settled
from panelweave.session import measured

FANOUT_BITS = 4  # runs of 16
BLOCK_BITS = 2 * FANOUT_BITS  # two levels of the tree are nested in one row: 256 nodes at most
PATH = "array<struct<left: string, right: string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it, so that fields cannot run together; null is ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def ranked(rows: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """Add ``rank`` (from 0 in its group) and ``n`` (rows of the group).

    Rows are dealt by ranges of group and order, so a large group takes many ranges; each range
    counts its groups, and those few counts give the rank at which a range begins.
    """
    keys = [F.col(group), *order]
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = settled(ranged.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part, row = F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part, group).agg(F.count(F.lit(1)).alias("c"), F.min(row).alias("begin"))
    w = Window.partitionBy(group)  # of one group: a row per range
    before = F.sum("c").over(w.orderBy("part")) - F.col("c") - F.col("begin")
    starts = measured(counts.select("part", group, before.alias("start"), F.sum("c").over(w).alias("n")))
    placed = placed.select("*", part, row.alias("row")).join(starts, ["part", group])
    return placed.withColumn("rank", F.col("start") + F.col("row")).drop("at", "part", "row", "start")


def rollup(nodes: DataFrame) -> DataFrame:
    """Nodes (``group, rank, n, digest, item``) to blocks of up to 256, one row each.

    A block has the columns of a node again (its rank among the blocks of the group, their
    number, its digest), ``below`` (nodes of the group before) and ``runs``: runs of 16, each with
    its digest and its ``leaves``. The two digits of the rank inside the block are grouped away
    in turn under one shuffle. Where one node is all there is, no level is added: it passes up.
    """
    digits = nodes.select(
        "group",
        F.shiftright("rank", BLOCK_BITS).alias("block"),
        F.shiftright("rank", FANOUT_BITS).bitwiseAND(F.lit(15)).cast("int").alias("run"),
        F.col("rank").bitwiseAND(F.lit(15)).cast("int").alias("slot"),
        F.col("n").alias("below"),
        "digest",
        "item",
    ).repartition("group", "block")
    leaves = F.sort_array(F.collect_list(F.struct("slot", "digest", "item"))).alias("leaves")
    runs = digits.groupBy("group", "below", "block", "run").agg(leaves)
    own = F.when(F.col("below") > 1, digest(joined(F.col("leaves.digest")))).otherwise(F.col("leaves.digest")[0])
    runs = runs.select("group", "below", "block", F.struct("run", own.alias("digest"), "leaves").alias("of_run"))
    blocks = runs.groupBy("group", "below", "block").agg(F.sort_array(F.collect_list("of_run")).alias("runs"))
    top = F.when(F.col("below") > 16, digest(joined(F.col("runs.digest")))).otherwise(F.col("runs.digest")[0])
    number = F.shiftright(F.col("below") + ((1 << BLOCK_BITS) - 1), BLOCK_BITS)
    return blocks.select("group", F.col("block").alias("rank"), number.alias("n"), top.alias("digest"), "below", "runs")


def siblings(digests: Column, place: Column) -> Column:
    """The digests before and after one place of a run, as one step of a path."""
    before = F.slice(digests, F.lit(1), place)
    after = F.slice(digests, place + 2, F.lit(16))
    return F.array(F.struct(joined(before).alias("left"), joined(after).alias("right")))


def members(blocks: DataFrame, *carried: str) -> DataFrame:
    """Nodes of blocks that have a ``path`` to the top: each node with its own path, by one
    transform over the nested runs and one explode."""
    none = F.array().cast(PATH)
    with_path = F.transform(
        "runs",
        lambda r: F.struct(
            r["run"].alias("run"),
            r["leaves"].alias("leaves"),
            F.concat(F.when(F.col("below") > 16, siblings(F.col("runs.digest"), r["run"])).otherwise(none), F.col("path")).alias("path"),
        ),
    )

    def nodes(r: Column) -> Column:
        return F.transform(
            r["leaves"],
            lambda leaf: F.struct(
                (F.shiftleft(F.col("rank"), BLOCK_BITS) + r["run"] * 16 + leaf["slot"]).alias("rank"),
                leaf["digest"].alias("digest"),
                leaf["item"].alias("item"),
                F.concat(F.when(F.col("below") > 1, siblings(r["leaves"]["digest"], leaf["slot"])).otherwise(none), r["path"]).alias("path"),
            ),
        )

    nested = blocks.select("group", "rank", "below", "runs", "path", *carried).withColumn("runs", with_path)
    return nested.select("group", *carried, F.inline(F.flatten(F.transform("runs", nodes))))


def tower(nodes: DataFrame) -> list[DataFrame]:
    """Rollups until each group is one block, lowest first; every one is settled."""
    floors = [settled(rollup(nodes), "blocks")]
    while not floors[-1].filter("n > 1").isEmpty():
        above = floors[-1].select("group", "rank", "n", "digest", F.lit(None).cast("int").alias("item"))
        floors.append(settled(rollup(above), "blocks"))
    return floors


def descend(top: DataFrame, floors: list[DataFrame], *carried: str) -> DataFrame:
    """Nodes of the lowest floor with their paths. ``top`` is the highest floor with ``path``.
    Blocks of a lower floor take theirs by (group, rank), one row each."""
    at = members(top, *carried)
    for floor in reversed(floors[:-1]):
        at = members(floor.join(at.select("group", "rank", "path", *carried), ["group", "rank"]), *carried)
    return at


def proofs(leaves: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Leaves (``group`` string, ``digest``, ``item``, and the columns of the order) with the path
    to the root of the whole table.

    Per group the leaves ascend by ``order``; while several nodes remain, each 16 consecutive
    ones (the last run may be shorter) become the digest of their digests. What remains is the
    ``subroot``; the subroots, by group, give the ``root`` in the same way. ``path`` lists for
    each level the digests before and after, lowest first. Returns group, rank, digest, item,
    path, subroot, root; no leaves give no rows. Up to 256 nodes share a row, never a group.
    """
    floors = tower(ranked(leaves, "group", order).select("group", "rank", "n", "digest", "item"))
    subroots = floors[-1].select(F.lit("").alias("group"), F.col("group").alias("item"), "digest")
    groups = ranked(subroots, "group", [F.col("item")])
    above = tower(groups)
    empty = F.array().cast(PATH)
    roots = descend(above[-1].select("*", empty.alias("path"), F.col("digest").alias("root")), above, "root")
    at_top = settled(roots.select(F.col("item").alias("group"), F.col("digest").alias("subroot"), "root", "path"), "subroots")
    return descend(floors[-1].join(at_top, "group"), floors, "subroot", "root")


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf gives with the digests beside its path."""
    return F.aggregate(path, leaf, lambda acc, step: digest(step["left"], acc, step["right"]))


def document_leaves(docs: DataFrame) -> DataFrame:
    """``group``, ``doc_id``, ``digest`` and ``item`` (doc_id and the digest after tampering, null where
    nothing is tampered with). A null source is a group of its own before all others."""
    source = F.col("source").cast("string")
    group = F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))
    head = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    changed = digest(*head, field(F.translate("text", UPPER, LOWER)))
    return docs.select(
        group.alias("group"),
        "doc_id",
        digest(*head, field(F.col("text"))).alias("digest"),
        F.struct("doc_id", F.when(F.pmod(crc, F.lit(5)) == 0, changed).alias("tampered")).alias("item"),
    )


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof of each document, and what a verifier makes of a copy in
    which the texts of some documents (those whose crc32 of the decimal id 5 divides) are
    lower-cased (A-Z).

    Needs doc_id, source, lang, n_chars and text; each may be null. Rows with equal ids ascend
    by leaf, a null id comes first and is never tampered with; equal rows have equal leaves and
    proofs of their own places. An empty table gives no rows. Other columns are not looked at.
    """
    leaves = settled(document_leaves(docs), "leaves")
    placed = proofs(leaves, [F.col("doc_id").asc_nulls_first(), F.col("digest")])
    out = placed.select(
        F.col("item.doc_id").alias("doc_id"),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.sha2(joined(F.transform("path", lambda s: F.concat(s["left"], s["right"]))), 256).alias("proof_sha256"),
        fold(F.col("path"), F.coalesce("item.tampered", "digest")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 5, source_levels: int = 3) -> str:
    """DuckDB SQL for ``manifest`` up to 16^levels documents a source and 16^source_levels sources."""
    value = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    head = " || ".join(value.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    # CRC-32 by its bits, since DuckDB has no function for it
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    codes = "[4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)"
    crc = f"xor(list_reduce({codes}, lambda c, b: {bits}), 4294967295)"
    ctes = [
        f"""l AS (SELECT doc_id, source, sha256({head} || {value.format("text")}) AS leaf,
             CASE WHEN ({crc}) % 5 = 0 THEN sha256({head} || {value.format("translate(text, '" + UPPER + "', '" + LOWER + "')")}) END AS tampered FROM documents)""",
        """r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM l)""",
        "a0 AS (SELECT source, rank, leaf AS d FROM r)",
    ]

    def climb(name: str, key: str, n: int) -> None:
        for k in range(n):
            run = f"PARTITION BY {key}, rank // 16 ORDER BY rank ROWS BETWEEN"
            ctes.append(f"""{name}s{k} AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS n,
                coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
                coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights FROM {name}{k})""")
            ctes.append(f"""{name}{k + 1} AS (SELECT {key}, rank // 16 AS rank,
                CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY rank)) ELSE any_value(d) END AS d FROM {name}s{k} GROUP BY {key}, rank // 16)""")

    climb("a", "source", levels)
    ctes.append(f"b0 AS (SELECT 0 AS one, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank, d FROM a{levels})")
    climb("b", "one", source_levels)
    joins, steps = [], []
    for k in range(levels):
        joins.append(f"JOIN as{k} ON as{k}.source IS NOT DISTINCT FROM r.source AND as{k}.rank = r.rank // {16**k}")
        steps.append(f"as{k}")
    joins.append("JOIN b0 ON b0.source IS NOT DISTINCT FROM r.source")
    for k in range(source_levels):
        joins.append(f"JOIN bs{k} ON bs{k}.rank = b0.rank // {16**k}")
        steps.append(f"bs{k}")
    picked = ", ".join(f"{s}.lefts AS l{i}, {s}.rights AS r{i}, {s}.n AS n{i}" for i, s in enumerate(steps))
    ctes.append(f"""p AS (SELECT doc_id, leaf, tampered, b0.d AS subroot, b{source_levels}.d AS root, {picked} FROM r {" ".join(joins)}, b{source_levels})""")
    fold_sql = "coalesce(tampered, leaf)"
    for i in range(len(steps)):
        ctes.append(f"f{i} AS (SELECT *, CASE WHEN n{i} > 1 THEN sha256(l{i} || {fold_sql} || r{i}) ELSE {fold_sql} END AS x{i} FROM {'p' if i == 0 else f'f{i - 1}'})")
        fold_sql = f"x{i}"
    proof = " || ".join(f"l{i} || r{i}" for i in range(len(steps)))
    return f"""WITH {", ".join(ctes)} SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, {fold_sql} AS folded_root, {fold_sql} = root AS verified
        FROM f{len(steps) - 1}"""
