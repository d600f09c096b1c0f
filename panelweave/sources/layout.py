"""Files that skip on several columns: a space-filling order, and what it saves a reader."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators.ranges import running_sum
from panelweave.session import measured
from panelweave.sources.tables import TABLE_FORMAT

BITS = 8


def rank_levels(df: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """Level of each distinct value: the share of rows with a smaller value in steps of 2^-bits, so
    that levels hold about as many rows each whatever the distribution is. Null comes first."""
    counts = df.groupBy(F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    summed = running_sum(counts, [F.col("_value").asc_nulls_first()], "_rows", "_smaller")
    total = measured(counts.agg(F.sum("_rows").alias("n"))).scalar()
    return measured(summed.select("_value", F.floor(F.col("_smaller") * (1 << bits) / total).cast("long").alias("_level")))


def interleaved(levels: Sequence[Column], bits: int = BITS) -> Column:
    """One number whose bits are those of all levels in turn, the highest first."""
    key = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for level in levels:
            key = F.shiftleft(key, 1).bitwiseOR(F.shiftright(level, b).bitwiseAND(F.lit(1)))
    return key


def write_zordered(df: DataFrame, path: str, columns: Sequence[str], bits: int = BITS, row_group_bytes: int | None = None, fmt: str = TABLE_FORMAT) -> None:
    """Overwrite a table in Z-order of the columns, so that row groups are narrow in each of them.

    A level table has a row per distinct value of a column; Catalyst broadcasts it if its size
    allows, else the join is shuffled and may be split on skew. Rows of equal levels go on by the
    columns themselves, so that a frequent value fills files of its own.
    """
    if bits * len(columns) > 62:
        raise ValueError("the levels do not fit a long")
    free = "_" * (1 + max(len(c) for c in df.columns))  # longer than any name, so no column of the table is hidden
    placed, names = df, [f"{free}{i}" for i in range(len(columns))]
    for name, c in zip(names, columns):
        levels = rank_levels(df, c, bits).toDF(free, name)
        placed = placed.join(levels, placed[c].eqNullSafe(levels[free]), "left").drop(free)
    order = [interleaved([F.col(n) for n in names], bits), *columns]
    writer = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop(*names).write.format(fmt).mode("overwrite")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.save(path)


def row_groups(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The row groups of Parquet files with the least and greatest value of each column, as text that
    sorts as the values do for strings and dates. Footers are read in tasks, a file each."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                meta = pq.ParquetFile(pa.BufferReader(content.as_buffer())).metadata
                at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    stats = [group.column(at[c]).statistics for c in columns]
                    rows.append([name, g, group.num_rows, *[str(v) for s in stats for v in ((s.min, s.max) if s and s.has_min_max else ("", "￿"))]])
            names = ["file", "row_group", "n_rows", *[f"{end}_{c}" for c in columns for end in ("low", "high")]]
            kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.string()] * (2 * len(columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    ends = "".join(f", `low_{c}` string, `high_{c}` string" for c in columns)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", "content")
    return files.mapInArrow(footers, f"file string, row_group int, n_rows long{ends}")


def groups_read(groups: DataFrame, column: str, value: Column) -> DataFrame:
    """How many of the row groups a reader of one value opens, of how many."""
    hit = value.cast("string").between(F.col(f"low_{column}"), F.col(f"high_{column}"))
    return groups.agg(F.count_if(hit).alias("groups_read"), F.count(F.lit(1)).alias("n_groups"))
