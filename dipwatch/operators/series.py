"""Series behind the live view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from dipwatch.constants import RATE_BEFORE_FIRST
from dipwatch.functions.minutes import block_of
from dipwatch.functions.stats import rate


def _since(rollup: DataFrame, since) -> DataFrame:
    recent = rollup.where(F.col("day") >= F.to_date(since)) if "day" in rollup.columns else rollup
    return recent.where(F.col("bucket") >= since)


def _sums():
    return [F.sum(m).alias(m) for m in ("attempts", "approved")]


def provider_series(rollup: DataFrame, since) -> DataFrame:
    return _since(rollup, since).groupBy("bucket", "provider_id").agg(*_sums())


def portfolio_series(rollup: DataFrame, since) -> DataFrame:
    return _since(rollup, since).groupBy("bucket").agg(*_sums())


def carried_rates(series: DataFrame, keep: int) -> DataFrame:
    """Rate per provider over the newest buckets, carried over empty ones.

    The list of newest buckets has at most ``keep`` entries and enters as a
    scalar subquery, so filling the grid needs no join.
    """
    recent = series.select("bucket").distinct().orderBy(F.desc("bucket")).limit(keep)
    listed = recent.agg(F.array_sort(F.collect_list("bucket")).alias("recent")).scalar()
    known = series.groupBy("provider_id").agg(F.count(F.lit(1)).alias("points"))
    grid = known.select("provider_id", F.explode(listed).alias("bucket"))
    rows = series.select("provider_id", "bucket", "attempts", "approved")
    filled = grid.join(rows, ["provider_id", "bucket"], "left")
    so_far = Window.partitionBy("provider_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(rate(F.col("approved"), F.col("attempts")), ignorenulls=True).over(so_far)
    return filled.select("provider_id", "bucket", F.coalesce(seen, F.lit(RATE_BEFORE_FIRST)).alias("rate"))


def latest_rates(series: DataFrame) -> DataFrame:
    """Rate of each provider's newest point, null if that had no attempts."""
    return series.groupBy("provider_id").agg(
        F.max("bucket").alias("bucket"),
        F.max_by(rate(F.col("approved"), F.col("attempts")), "bucket").alias("rate"),
    )


def marker_buckets(markers: DataFrame, calendar: DataFrame, last_minute) -> DataFrame:
    """First processed bucket at or after each marker's start, else the last one.

    ``markers``: marker_id, starts_minute (first whole minute at or after the
    start). Where the marker's own day has none, the first minute of the next
    day that has traffic counts, however far off; the window for that runs over
    one row a day.
    """
    placed = markers.withColumn("block", block_of(F.col("starts_minute")))
    days = placed.select("block").distinct().join(calendar.select("block", "minutes"), "block", "full_outer")
    later = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    days = days.withColumn("next", F.first(F.try_element_at("minutes", F.lit(1)), ignorenulls=True).over(later))
    own = F.try_element_at(F.filter("minutes", lambda m: m >= F.col("starts_minute")), F.lit(1))
    return placed.join(days, "block", "left").select("marker_id", F.coalesce(own, "next", last_minute).alias("minute"))
