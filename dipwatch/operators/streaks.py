"""Persistence: how many confirmed drop windows in a row each slice has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from dipwatch.constants import BLOCK_MIN, PERSISTENCE_WINDOWS
from dipwatch.functions.minutes import block_of, bucket_of
from dipwatch.functions.stats import DROP


def streaks(readings: DataFrame, keys: list[str] | None = None, block: int = BLOCK_MIN) -> DataFrame:
    """Add ``streak`` and ``first_minute`` to every confident reading.

    A drop extends the streak, any other confident reading ends it, a missing
    minute does neither. A streak can be arbitrarily long, so it is computed
    as a two-level scan: inside one day per slice, then over one summary row
    per slice and day, whose result is carried into the day. No task ever
    holds more than a day of one slice.
    """
    keys = keys or ["cell_key"]
    rows = readings.withColumn("_block", block_of(F.col("minute"), block)).withColumn(
        "_drop", (F.col("state") == DROP).cast("int")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("minute")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_island", F.sum(F.lit(1) - F.col("_drop")).over(running))
    island = Window.partitionBy(*keys, "_block", "_island").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_local", F.sum("_drop").over(island)).withColumn(
        "_local_first", F.min(F.when(F.col("_drop") == 1, F.col("minute"))).over(island)
    )

    # What each day hands on: its last island, and whether that started afresh.
    day = rows.groupBy(*keys, "_block").agg(
        F.max(F.struct("minute", "_island", "_local", "_local_first")).alias("last")
    ).select(
        *keys,
        "_block",
        (F.col("last._island") > 0).cast("int").alias("_fresh"),
        F.col("last._local").alias("_tail"),
        F.col("last._local_first").alias("_tail_first"),
    )
    over_days = Window.partitionBy(*keys).orderBy("_block")
    day = day.withColumn("_chain", F.sum("_fresh").over(over_days.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy(*keys, "_chain").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    day = day.withColumn("_end", F.sum("_tail").over(chain)).withColumn("_end_first", F.min("_tail_first").over(chain))
    carried = day.select(
        *keys,
        "_block",
        F.lag("_end", 1).over(over_days).alias("_carry"),
        F.lag("_end_first", 1).over(over_days).alias("_carry_first"),
    )

    joined = rows.join(carried, [*keys, "_block"], "left")
    open_before = (F.col("_island") == 0) & (F.coalesce(F.col("_carry"), F.lit(0)) > 0)
    return joined.withColumn(
        "streak",
        F.when(F.col("_drop") == 1, F.col("_local") + F.when(open_before, F.col("_carry")).otherwise(0)).otherwise(0),
    ).withColumn(
        "first_minute",
        F.when(F.col("_drop") == 1, F.when(open_before, F.col("_carry_first")).otherwise(F.col("_local_first"))),
    ).drop("_block", "_drop", "_island", "_local", "_local_first", "_carry", "_carry_first")


def promoted(with_streaks: DataFrame, windows: int = PERSISTENCE_WINDOWS) -> DataFrame:
    """Readings confirmed by enough windows; every later drop window confirms again."""
    return with_streaks.where(F.col("streak") >= windows)


def pending_spans(with_streaks: DataFrame, windows: int = PERSISTENCE_WINDOWS, keys: list[str] | None = None,
                  block: int = BLOCK_MIN) -> DataFrame:
    """Streaks still short of confirmation, with the span each one is shown for.

    A row is pending from its own bucket until the slice's next confident
    reading (``until_minute`` null: still pending).
    """
    keys = keys or ["cell_key"]
    rows = with_streaks.withColumn("_block", block_of(F.col("minute"), block))
    inside = Window.partitionBy(*keys, "_block").orderBy("minute")
    firsts = rows.groupBy(*keys, "_block").agg(F.min("minute").alias("_first"))
    nexts = firsts.select(
        *keys, "_block", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_block")).alias("_next_first")
    )
    return (
        rows.withColumn("_lead", F.lead("minute").over(inside))
        .where((F.col("streak") > 0) & (F.col("streak") < windows))
        .join(nexts, [*keys, "_block"], "left")
        .withColumn("until_minute", F.coalesce("_lead", "_next_first"))
        .withColumn("first_bucket", bucket_of("first_minute"))
        .withColumn("until_bucket", bucket_of("until_minute"))
        .withColumn("windows_required", F.lit(windows))
        .drop("_block", "_lead", "_next_first")
    )


def pending_at(spans: DataFrame, minute: Column) -> DataFrame:
    return spans.where((F.col("minute") <= minute) & (F.col("until_minute").isNull() | (F.col("until_minute") > minute)))
