"""Session settings and the shared folder that intermediate tables live in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A panel is bucketed and shuffled by its series key. The first setting lets a join on
# (series key + day) reuse that layout, so only the other side moves.
SQL_SETTINGS = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HotSpot leaves longer methods uncompiled; above this Spark splits the code instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

_own_folder: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the plans of this package rely on."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder of this application under ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a temporary folder.
    """
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None) or _own_folder.get(app)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = _own_folder[app] = tempfile.mkdtemp(prefix="panelweave-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/panelweave/{app}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has been written to yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and return it from there: computed once, its lineage cut."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame) -> DataFrame:
    """Write a small aggregate to the shared folder and return it from there.

    Catalyst then plans joins with it from the bytes on disk: a broadcast below
    ``spark.sql.autoBroadcastJoinThreshold``, a shuffle join that AQE may split on skew above
    it. Nothing is broadcast on trust, the aggregate is computed once however often it is
    used, and losing an executor does not lose it.
    """
    return written(df, "small")


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Catalyst knows the table to be below ``spark.sql.autoBroadcastJoinThreshold``."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit
