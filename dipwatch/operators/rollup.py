"""Ingest operators: first write wins, minute rollups, additive merge, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from dipwatch.constants import DIMS, MEASURES, RETENTION_MIN

CELL = ["bucket", *DIMS]
DECLINE_CELL = [*CELL, "decline_code"]


def first_write(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Keep one row per key, the smallest under a total order.

    Spark turns ``row_number() = 1`` into a window group limit that already
    drops all but one row per key before the shuffle, so a key delivered a
    billion times reaches the reducer once per map task.
    """
    ranked = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") == 1).drop("_rank")


def new_only(rows: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the sink does not hold yet."""
    return rows.join(stored.select(*key), key, "left_anti")


def with_bucket(tx: DataFrame) -> DataFrame:
    return tx.withColumn("bucket", F.date_trunc("minute", "created_at"))


def minute_rollup(tx: DataFrame) -> DataFrame:
    approved = F.col("status") == "SUCCESS"
    return with_bucket(tx).groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count(F.when(approved, 1)).alias("approved"),
        F.sum("amount_minor").alias("amount_minor_sum"),
        F.sum("amount_usd_minor").alias("amount_usd_sum"),
        F.coalesce(F.sum(F.when(approved, F.col("amount_usd_minor"))), F.lit(0).cast("bigint")).alias("approved_usd_sum"),
    )


def decline_rollup(tx: DataFrame) -> DataFrame:
    declined = with_bucket(tx).where((F.col("status") == "DECLINED") & F.col("decline_code").isNotNull())
    return declined.groupBy(*DECLINE_CELL).agg(F.count(F.lit(1)).alias("declines"))


def merge_rollups(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Additive upsert: partial sums of both sides meet in one aggregation."""
    return old.unionByName(delta).groupBy(*CELL).agg(*[F.sum(m).alias(m) for m in MEASURES])


def merge_decline_rollups(old: DataFrame, delta: DataFrame) -> DataFrame:
    return old.unionByName(delta).groupBy(*DECLINE_CELL).agg(F.sum("declines").alias("declines"))


def keep_since(tx: DataFrame, now: Column, minutes: int = RETENTION_MIN) -> DataFrame:
    """Retention: rows not older than the cutoff; zero minutes switches it off."""
    if minutes == 0:
        return tx
    return tx.where(F.col("created_at") >= now - F.expr(f"INTERVAL {minutes} MINUTES"))


def closed_only(rollup: DataFrame, now: Column, grace_seconds: int = 10) -> DataFrame:
    """Buckets whose minute ended at least the grace period ago."""
    last = F.date_trunc("minute", now - F.expr(f"INTERVAL {grace_seconds} SECONDS")) - F.expr("INTERVAL 1 MINUTE")
    return rollup.where(F.col("bucket") <= last)
