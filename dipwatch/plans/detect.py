"""Detection as one batch plan over any range of minutes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipwatch.constants import DIMS, PERSISTENCE_WINDOWS
from dipwatch.functions.minutes import bucket_of, calendar
from dipwatch.operators import readings as R
from dipwatch.operators.onset import SERIES, collect_lookback, with_onset
from dipwatch.operators.slices import cell_series
from dipwatch.operators.streaks import promoted, streaks
from dipwatch.session import stage


@dataclass(frozen=True)
class Detection:
    readings: DataFrame
    streaks: DataFrame
    signals: DataFrame
    gaps: DataFrame


def all_readings(rollup: DataFrame, merchants: DataFrame, coverage: DataFrame) -> DataFrame:
    """The readings table. Hypotheses are read twice (family size, verdicts), so both are written once."""
    tested = stage(R.hypotheses(rollup, merchants, coverage), "hypotheses")
    return stage(R.readings(tested, R.families(tested)), "readings")


def signals(confirmed: DataFrame, rollup: DataFrame) -> DataFrame:
    """Confirmed drops with their onset."""
    wanted = confirmed.withColumn("request_id", F.concat_ws("@", F.col("minute").cast("string"), F.col("cell_key")))
    wanted = stage(wanted, "confirmed")
    cells = wanted.select(
        *DIMS, (F.col("minute") - 120).alias("from_minute"), F.col("minute").alias("to_minute")
    )
    series = cell_series(rollup, cells, ("attempts", "approved"))
    collected = collect_lookback(wanted, series, SERIES)
    return with_onset(collected, calendar(rollup)).select(
        "bucket", "minute", "split", *DIMS, "cell_key", F.col("observed").alias("observed_rate"),
        F.col("expected").alias("expected_rate"), "expected_source", "delta_pp", "ci_low", "ci_high",
        F.lit(0.95).alias("ci_level"), "attempts", "approved", "window_used", "started_minute", "started_at",
        "started_at_exact", F.col("streak").alias("consecutive_windows"), bucket_of("first_minute").alias("first_bucket"),
    )


def detect(rollup: DataFrame, merchants: DataFrame, coverage: DataFrame,
           windows: int = PERSISTENCE_WINDOWS) -> Detection:
    read = all_readings(rollup, merchants, coverage)
    counted = streaks(R.confident(read))
    return Detection(read, counted, signals(promoted(counted, windows), rollup), R.gaps(read))
