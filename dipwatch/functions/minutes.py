"""Minute arithmetic, and look-back windows whose groups stay bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from dipwatch.constants import BLOCK_MIN


def minute_of(ts: str = "bucket") -> Column:
    return F.expr(f"unix_seconds({ts}) div 60")


def bucket_of(minute: Column | str) -> Column:
    minute = F.col(minute) if isinstance(minute, str) else minute
    return F.timestamp_seconds(minute * F.lit(60))


def block_of(minute: Column, block: int = BLOCK_MIN) -> Column:
    return F.floor(minute / F.lit(block)).cast("long")


def blocks_between(start: Column, end: Column, block: int = BLOCK_MIN) -> Column:
    return F.sequence(block_of(start, block), block_of(end, block))


def with_trailing(rows: DataFrame, keys: list[str], lookback: int, outputs: dict, block: int = BLOCK_MIN) -> DataFrame:
    """Trailing RANGE aggregates over ``minute`` per key.

    ``outputs`` maps a name to ``(aggregate column, minutes back, minutes back to)``.
    Partitioning by key alone would put the whole history of a key in one task.
    Here a group is one key in one time block; rows within ``lookback`` of the
    end of a block are also sent to the next one, which is all it needs.
    """
    spread = rows.withColumn(
        "_block", F.explode(blocks_between(F.col("minute"), F.col("minute") + F.lit(lookback), block))
    )
    order = Window.partitionBy(*keys, "_block").orderBy("minute")
    for name, (agg, back, back_to) in outputs.items():
        spread = spread.withColumn(name, agg.over(order.rangeBetween(-back, -back_to)))
    return spread.where(F.col("_block") == block_of(F.col("minute"), block)).drop("_block")


def calendar(rows: DataFrame, block: int = BLOCK_MIN) -> DataFrame:
    """The processed minutes, one row per day: ``(block, minutes, before)``.

    ``minutes`` are the day's distinct buckets (at most 1440), ``before`` those
    of the day before, which an equi-join on the block brings in.
    """
    days = (
        rows.select("minute").distinct()
        .groupBy(block_of(F.col("minute"), block).alias("block"))
        .agg(F.array_sort(F.collect_list("minute")).alias("minutes"))
    )
    earlier = days.select((F.col("block") + 1).alias("block"), F.col("minutes").alias("before"))
    empty = F.array().cast("array<bigint>")
    return days.join(earlier, "block", "left").select("block", "minutes", F.coalesce("before", empty).alias("before"))


def trail(minute: Column, lookback: int) -> Column:
    """Processed minutes in ``[minute - lookback, minute]``, from calendar columns."""
    return F.filter(
        F.concat(F.col("before"), F.col("minutes")),
        lambda m: (m >= minute - F.lit(lookback)) & (m <= minute),
    )
