"""Reading and writing tables: CSV, Parquet (or another table format), partitioned,
clustered and series-bucketed layouts."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelweave.session import fresh_path

TABLE_FORMAT = "parquet"


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header; the schema is declared, since inference reads the files twice."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, fmt: str = TABLE_FORMAT) -> DataFrame:
    return spark.read.format(fmt).load(path)


def content_key(spark: SparkSession, *paths: str) -> str:
    """A digest of the files of tables, by path, size and time of change: another one as soon as a
    table is rewritten or grows. Lists files, reads none."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    seen = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(conf).listFiles(at, True)
        while files.hasNext():
            status = files.next()
            seen.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return hashlib.md5(repr(sorted(seen)).encode()).hexdigest()[:12]


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = TABLE_FORMAT) -> None:
    """Overwrite a table, its schema included; rows of a partition value may span files,
    so a value that holds most rows is still written by many tasks."""
    writer = df.write.format(fmt).mode("overwrite").option("overwriteSchema", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_clustered(
    df: DataFrame,
    path: str,
    cluster_by: Sequence[str],
    partition_by: Sequence[str] = (),
    fmt: str = TABLE_FORMAT,
) -> None:
    """Write files that each cover a narrow range of ``cluster_by``, so readers skip row
    groups by their min/max. With the delta format, the table is Z-ordered instead."""
    if fmt == "delta":
        write_table(df, path, partition_by, fmt)
        df.sparkSession.sql(f"OPTIMIZE delta.`{path}` ZORDER BY ({', '.join(cluster_by)})")
        return
    ranged = df.repartitionByRange(*cluster_by).sortWithinPartitions(*partition_by, *cluster_by)
    write_table(ranged, path, partition_by, fmt)


def bucket_count(spark: SparkSession) -> int:
    """As many buckets as shuffle partitions: the setting that is fitted to the data, not to the
    cores that happen to be there."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def save_series_table(
    df: DataFrame,
    name: str,
    keys: Sequence[str],
    order: str,
    partition_by: Sequence[str] = (),
    buckets: int | None = None,
    placed: bool = False,
) -> DataFrame:
    """Save a panel bucketed by its series key and sorted by day within each bucket.

    Windows, per-series aggregates, grouped maps and joins on the series key then read the
    table without a shuffle. One file per bucket and partition value. ``placed`` says that
    the rows come from series tables with as many buckets and never left their place, so
    that they are written where they are.
    """
    spark = df.sparkSession
    n = buckets or bucket_count(spark)
    rows = df if placed else df.repartition(n, *keys)
    writer = (
        rows.write.format("parquet")
        .mode("overwrite")
        .bucketBy(n, *keys)
        .sortBy(*keys, order)
        .option("path", fresh_path(spark, name))
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)
    return spark.table(name)


def table_shape(df: DataFrame, name: str) -> DataFrame:
    """Row and column count of a table, as one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
    )
