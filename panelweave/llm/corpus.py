"""Tables of the corpus, tables between jobs, and positions in a global order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.session import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read from there: computed once, lineage cut, and there
    for all executors when one is lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Ask the driver's JVM to collect its garbage, since shuffle files of finished jobs stay on
    the executors' disks until it does."""
    spark._jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Remove the files of settled tables that nothing will read again: what was made from them
    is settled itself. Shuffle files of finished jobs go too."""
    for frame in frames:
        folders = {f.rsplit("/", 1)[0] for f in frame.inputFiles()}
        jvm, conf = frame.sparkSession._jvm, frame.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
    if frames:
        release(frames[0].sparkSession)


def apart(docs: DataFrame, needed: Sequence[str], operator: Callable[[DataFrame], DataFrame], replaced: Sequence[str] = ()) -> DataFrame:
    """Run an operator that carries all columns along, with every column it has no use for under a
    neutral name, so that no name a user may choose meets one that the operator works with. The
    columns come back under their own names, those of ``replaced`` only as the operator makes
    them."""
    others = [c for c in docs.columns if c not in needed and c not in replaced]
    neutral = {c: f"carried {i}" for i, c in enumerate(others)}
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    out = operator(docs.select(*[named(c) for c in needed], *[named(c).alias(n) for c, n in neutral.items()]))
    kept = {c: neutral.get(c, c) for c in docs.columns if c not in replaced and neutral.get(c, c) in out.columns}
    made = [c for c in out.columns if c not in kept.values()]
    return out.select(*[named(n).alias(c) for c, n in kept.items()], *[named(c) for c in made])


def id_crc(column: str = "doc_id") -> Column:
    """CRC-32 of the id as decimal text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: Sequence[Column], name: str = "position", weight: str | None = None) -> DataFrame:
    """Add the place (from 0) of each row in the order, over all rows and without one task
    that sees them all; with ``weight``, the sum of that column over the rows before.

    Rows are dealt by ranges of the order and sorted inside them. That table is settled, each
    range is counted, and the few counts are added up. Only order ties beyond a full range
    meet in one task, so end the order with a unique key.
    """
    ranged = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    at = f"_{name}"
    placed = settled(ranged.withColumn(at, F.monotonically_increasing_id()), "ordered")
    part, row = F.shiftright(F.col(at), 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n") if weight is None else F.sum(weight).alias("_n"))
    before = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"),  # one row per range
    )
    if weight is None:
        inside: Column = row
    else:
        inside = F.sum(weight).over(Window.partitionBy("_part").orderBy(at)) - F.col(weight)
    joined = placed.withColumn("_part", part).join(before, "_part")
    return joined.withColumn(name, F.col("_before") + inside).drop("_part", "_before", at)
