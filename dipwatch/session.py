"""Session settings and the shared staging area used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings the results depend on (buckets are UTC minutes)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    made = tempfile.mkdtemp(prefix="dipwatch-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stage_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/dipwatch/{app}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage with a table that survives lost executors and that, unlike an
    RDD checkpoint, carries file sizes: Catalyst then broadcasts a side only
    when its real size is under ``spark.sql.autoBroadcastJoinThreshold``.
    ``by`` partitions the files; the rebalance splits a heavy value over
    several tasks and joins light ones, so neither hot days nor tiny files occur.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    if by is None:
        df.write.parquet(path)
    else:
        df.hint("rebalance", by).write.partitionBy(by).parquet(path)
        df = df.select(*[c for c in df.columns if c != by], by)
    return spark.read.schema(df.schema).parquet(path)
