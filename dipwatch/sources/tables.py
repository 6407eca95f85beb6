"""Scans over the rollup tables, written so that every predicate reaches the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dipwatch.functions.minutes import minute_of
from dipwatch.operators.rollup import CELL, DECLINE_CELL, decline_rollup, minute_rollup, with_bucket
from dipwatch.session import prepare, stage
from dipwatch.sources.payments import payments


def on_days(table: DataFrame, start: Column, end: Column | None = None) -> DataFrame:
    """Partition filter for a time range; tables without a day column pass through."""
    if "day" not in table.columns:
        return table
    kept = table.where(F.col("day") >= F.to_date(start))
    return kept if end is None else kept.where(F.col("day") <= F.to_date(end))


def window_rows(rollup: DataFrame, bucket: Column) -> DataFrame:
    return on_days(rollup, bucket, bucket).where(F.col("bucket") == bucket)


def history(rollup: DataFrame, start: Column, end: Column) -> DataFrame:
    """Half-open range ``[start, end)``."""
    return on_days(rollup, start, end).where((F.col("bucket") >= start) & (F.col("bucket") < end))


def set_expected_conversion(merchants: DataFrame, value: float) -> DataFrame:
    """One value for every merchant."""
    return merchants.withColumn("expected_conversion", F.lit(float(value)))


def dated_rates(tx: DataFrame, rates: DataFrame) -> DataFrame:
    """Attach the rate of the payment's currency and day; the frozen one stays the source of truth."""
    return tx.withColumn("rate_date", F.to_date("created_at")).join(rates, ["currency", "rate_date"], "left")


def _by_day(table: DataFrame, name: str) -> DataFrame:
    return stage(table.withColumn("day", F.to_date("bucket")), name, "day")


def rollup_table(spark: SparkSession, folder: str) -> DataFrame:
    """The minute rollup as a table. Everything downstream reads this, never raw rows."""
    prepare(spark)
    return _by_day(minute_rollup(payments(spark, folder)).withColumn("minute", minute_of()), "rollup")


def decline_table(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return _by_day(decline_rollup(payments(spark, folder)).withColumn("minute", minute_of()), "declines")


def both_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both rollups from one pass over the fact.

    The decline code joins the grouping key of a single aggregation; the two
    tables are cheap re-groupings of that staged result.
    """
    prepare(spark)
    approved = F.col("status") == "SUCCESS"
    detail = stage(
        with_bucket(payments(spark, folder)).groupBy(*DECLINE_CELL, approved.alias("ok")).agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("amount_minor").alias("local"),
            F.sum("amount_usd_minor").alias("usd"),
        ).withColumn("minute", minute_of()),
        "detail",
    )
    zero = F.lit(0).cast("bigint")
    rollup = detail.groupBy(*CELL, "minute").agg(
        F.sum("rows").alias("attempts"),
        F.sum(F.when(F.col("ok"), F.col("rows")).otherwise(zero)).alias("approved"),
        F.sum("local").alias("amount_minor_sum"),
        F.sum("usd").alias("amount_usd_sum"),
        F.sum(F.when(F.col("ok"), F.col("usd")).otherwise(zero)).alias("approved_usd_sum"),
    )
    declines = detail.where(~F.col("ok")).select(*DECLINE_CELL, "minute", F.col("rows").alias("declines"))
    return _by_day(rollup, "rollup"), _by_day(declines, "declines")
