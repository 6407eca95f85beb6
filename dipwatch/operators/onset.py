"""Onset: the first minute of the run of bad minutes that leads up to a detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipwatch.constants import MIN_VOLUME, ONSET_LOOKBACK_MIN, PERSISTENCE_WINDOWS
from dipwatch.functions.minutes import block_of, bucket_of, trail
from dipwatch.functions.stats import rate
from dipwatch.operators.slices import join_series

SERIES = ["attempts", "approved"]


def collect_lookback(requests: DataFrame, series: DataFrame, value_columns: list[str], id_column: str = "request_id",
                     lookback: int = ONSET_LOOKBACK_MIN) -> DataFrame:
    """Attach each request's own minutes as ``seen``, at most ``lookback + 1`` entries."""
    ranged = requests.withColumn("from_minute", F.col("minute") - F.lit(lookback)).withColumn("to_minute", F.col("minute"))
    joined = join_series(ranged, series, value_columns)
    entry = F.struct(F.col("row_minute").alias("minute"), *[F.col(f"row_{c}").alias(c) for c in value_columns])
    seen = joined.groupBy(id_column).agg(
        F.collect_list(F.when(F.col("row_minute").isNotNull(), entry)).alias("seen")
    )
    return requests.join(seen, id_column, "left")


def with_onset(collected: DataFrame, calendar: DataFrame, expected: str = "expected", delta_pp: str = "delta_pp",
               lookback: int = ONSET_LOOKBACK_MIN) -> DataFrame:
    """Add ``started_at``, ``started_at_exact`` and ``evidence_minutes``.

    ``collected`` holds ``minute``, the expected rate and ``seen``. The walk
    back runs over the processed minutes of all merchants (``calendar``): a
    minute in which the slice was idle is not healthy and makes the start
    inexact.
    """
    on_day = collected.withColumn("block", block_of(F.col("minute"))).join(calendar, "block", "left")
    limit = F.col(expected) - F.col(delta_pp) / F.lit(100.0)
    thick = on_day.withColumn("_trail", trail(F.col("minute"), lookback)).withColumn(
        "_thick", F.filter("seen", lambda r: r["attempts"] >= MIN_VOLUME)
    ).withColumn("_limit", limit)
    healthy = F.filter(F.col("_thick"), lambda r: rate(r["approved"], r["attempts"]) >= F.col("_limit"))
    cut = thick.withColumn("_last_good", F.array_max(F.transform(healthy, lambda r: r["minute"]))).withColumn(
        "_run",
        F.filter("_trail", lambda m: F.col("_last_good").isNull() | (m > F.col("_last_good"))),
    )
    run_thick = F.size(F.filter(
        F.col("_thick"), lambda r: F.col("_last_good").isNull() | (r["minute"] > F.col("_last_good"))
    ))
    long_enough = F.size("_run") >= PERSISTENCE_WINDOWS
    start = F.when(long_enough, F.try_element_at(F.col("_run"), F.lit(1))).otherwise(F.col("minute"))
    return (
        cut.withColumn("started_minute", start)
        .withColumn("started_at", bucket_of("started_minute"))
        .withColumn("started_at_exact", long_enough & (run_thick == F.size("_run")))
        .withColumn("evidence_minutes", F.col("_run"))
        .withColumn("run_thick", run_thick)
        .drop("block", "minutes", "before", "_trail", "_thick", "_limit", "_last_good", "_run")
    )
