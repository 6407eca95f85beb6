"""Streak state per slice across micro-batches, and the minute job built on it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dipwatch.functions.stats import DROP

STREAK_SCHEMA = "cell_key string, minute long, state string, streak long, first_minute long"
STATE_SCHEMA = "streak long, first_minute long"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    """Continue one slice's streak over the readings of this micro-batch."""
    streak, first = held.get if held.exists else (0, None)
    rows = pd.concat(list(frames)).sort_values("minute")
    dropped = rows["state"].eq(DROP)
    island = (~dropped).cumsum()
    local = dropped.astype("int64").groupby(island).cumsum()
    start = rows["minute"].where(dropped).groupby(island).transform("min")
    open_before = island.eq(0) & dropped & (streak > 0)
    out = pd.DataFrame({
        "cell_key": key[0], "minute": rows["minute"], "state": rows["state"],
        "streak": (local + open_before * streak).astype("int64"),
        "first_minute": start.where(~open_before, first).where(dropped),
    })
    last = out.iloc[-1]
    if last["streak"] > 0:
        held.update((int(last["streak"]), int(last["first_minute"])))
    elif held.exists:
        held.remove()
    out["first_minute"] = out["first_minute"].astype("Int64")
    yield out


def streaming_streaks(readings: DataFrame) -> DataFrame:
    """Same result as the batch operator, for a stream of confident readings in event order."""
    return readings.select("cell_key", "minute", "state").groupBy("cell_key").applyInPandasWithState(
        _advance, STREAK_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )


def continue_streaks(new: DataFrame, carried: DataFrame) -> DataFrame:
    """Streaks of newly processed minutes on top of a stored (cell_key, streak, first_minute) table.

    For jobs that keep the state in a table and call the batch operators from
    ``foreachBatch``. ``new`` spans at most the catch-up limit of minutes.
    """
    running = Window.partitionBy("cell_key").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    drop = (F.col("state") == DROP).cast("int")
    rows = new.withColumn("_island", F.sum(1 - drop).over(running))
    inside = Window.partitionBy("cell_key", "_island").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "_local": F.sum(drop).over(inside), "_first": F.min(F.when(drop == 1, F.col("minute"))).over(inside),
    }).join(
        carried.select("cell_key", F.col("streak").alias("_carry"), F.col("first_minute").alias("_carry_first")),
        "cell_key", "left",
    )
    open_before = (F.col("_island") == 0) & (F.coalesce("_carry", F.lit(0)) > 0)
    return rows.withColumns({
        "streak": F.when(drop == 1, F.col("_local") + F.when(open_before, F.col("_carry")).otherwise(0)).otherwise(0),
        "first_minute": F.when(drop == 1, F.when(open_before, F.col("_carry_first")).otherwise(F.col("_first"))),
    }).drop("_island", "_local", "_first", "_carry", "_carry_first")


def carry_over(carried: DataFrame, advanced: DataFrame) -> DataFrame:
    """State after the new minutes: last reading per slice, untouched slices as they were.

    Whatever columns ``carried`` has besides the key are taken from the last reading.
    """
    columns = [c for c in carried.columns if c != "cell_key"]
    last = advanced.groupBy("cell_key").agg(F.max_by(F.struct(*columns), F.col("minute")).alias("s")).select(
        "cell_key", *[F.col(f"s.{c}").alias(c) for c in columns]
    )
    kept = carried.join(last, "cell_key", "left_anti").select("cell_key", *columns)
    return kept.unionByName(last.where(F.col("streak") > 0))
