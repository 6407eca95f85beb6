"""The monitor as a streaming job: ingest, then every closed minute through to incidents.

Each micro-batch appends to tables of a ``Store`` under its own batch id and
reads state only from earlier ids, so a batch that is run again gives the same
tables. All work is done by the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipwatch.constants import (DECLINE_CURRENT_LOOKBACK_MIN, DECLINE_HISTORY_LOOKBACK_MIN, GRACE_SECONDS,
                                PERSISTENCE_WINDOWS, RECENT_BUCKETS)
from dipwatch.functions.minutes import minute_of
from dipwatch.operators import readings as R
from dipwatch.operators import series as S
from dipwatch.operators.evidence import evidence
from dipwatch.operators.incidents import LOG_SCHEMA, incident_log, live_incidents
from dipwatch.operators.rollup import merge_decline_rollups, merge_rollups
from dipwatch.operators.streaks import promoted
from dipwatch.plans.detect import all_readings, signals
from dipwatch.plans.diagnose import diagnose
from dipwatch.session import stage
from dipwatch.streaming.ingest import Store, ingest_batch
from dipwatch.streaming.persistence import carry_over, continue_streaks

# Open streaks with the reading that last extended each, which is what a pending card shows.
STREAK_STATE = ("cell_key string, streak bigint, first_minute bigint, minute bigint, observed double, expected double, expected_source string,"
                " delta_pp double, ci_low double, ci_high double, attempts bigint, approved bigint, window_used string")
ROLLUP = ("bucket timestamp, merchant_id string, provider_id string, country string, payment_method string, issuer_id string,"
          " attempts bigint, approved bigint, amount_minor_sum bigint, amount_usd_sum bigint, approved_usd_sum bigint")
DECLINES = ("bucket timestamp, merchant_id string, provider_id string, country string, payment_method string, issuer_id string,"
            " decline_code string, declines bigint")
# What the incident fold reads of an evidence row.
NO_EVIDENCE = ("request_id string, bucket timestamp, minute bigint, merchant_id string, provider_id string, country string,"
               " payment_method string, issuer_id string, cell_key string, priority_score double")
REACH = DECLINE_CURRENT_LOOKBACK_MIN + DECLINE_HISTORY_LOOKBACK_MIN


class MinuteJob:
    def __init__(self, store: Store, merchants: DataFrame, coverage: DataFrame, catalog: DataFrame,
                 windows: int = PERSISTENCE_WINDOWS, catch_up: int | None = None):
        self.store, self.spark = store, store.spark
        self.merchants, self.coverage, self.catalog, self.windows = merchants, coverage, catalog, windows
        self.catch_up = catch_up

    def _schema(self, text: str):
        return self.spark.createDataFrame([], text).schema

    def _state(self, table: str, schema: str, batch_id: int) -> DataFrame:
        """Rows written by earlier batches; empty before the first one."""
        try:
            return self.store.read(table, self._schema(schema), before=batch_id)
        except AnalysisException:
            return self.spark.createDataFrame([], schema + ", batch_id bigint")

    def _latest(self, table: str, schema: str, batch_id: int) -> DataFrame:
        """A table that every batch rewrites whole: its newest earlier version."""
        rows = self._state(table, schema, batch_id)
        newest = rows.agg(F.max("batch_id").alias("b")).scalar()
        return rows.where(F.col("batch_id") == newest).drop("batch_id")

    def _recent(self, table: str, schema: str, start: int, end: int) -> DataFrame:
        rows = self.store.read(table, self._schema(schema)).drop("batch_id")
        low, high = F.timestamp_seconds(F.lit(start * 60)), F.timestamp_seconds(F.lit(end * 60))
        return rows.where((F.col("bucket") >= low) & (F.col("bucket") <= high))

    def _plan(self, batch_id: int) -> tuple[int, int] | None:
        """First and last minute to process: closed, and after the cursor or from the first stored one on.

        However long the backlog, it is one batch plan over a range. ``catch_up`` limits it to the newest minutes if asked to.
        """
        facts = self.spark.read.schema("created_at timestamp").parquet(f"{self.store.path}/facts")
        seconds = F.unix_seconds("created_at")
        oldest, newest = facts.agg(F.min(seconds), F.max(seconds) - GRACE_SECONDS).first()
        if newest is None:
            return None
        target = newest // 60 - 1
        done = self._state("cursor", "minute bigint", batch_id).agg(F.max("minute").alias("m")).first().m
        first = oldest // 60 if done is None else done + 1
        if self.catch_up is not None:
            first = max(first, target - self.catch_up + 1)
        return (first, target) if first <= target else None

    def each(self, ingest: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        def run(batch: DataFrame, batch_id: int) -> None:
            ingest(batch, batch_id)
            self.process(batch_id)

        return run

    def run_batch(self, order: list[str], **options) -> Callable[[DataFrame, int], None]:
        return self.each(ingest_batch(self.store, order, **options))

    def _evidence(self, confirmed: DataFrame, rollup: DataFrame, declines: DataFrame) -> DataFrame:
        """Evidence of the confirmed drops. A quiet minute skips the search and the decline reads."""
        if confirmed.isEmpty():
            return self.spark.createDataFrame([], NO_EVIDENCE)
        return stage(evidence(diagnose(confirmed, rollup, declines, self.merchants, self.coverage, self.catalog)), "evidence")

    def process(self, batch_id: int) -> None:
        span = self._plan(batch_id)
        streak_state = self._latest("streak_state", STREAK_STATE, batch_id)
        if span is None:
            self.store.write(streak_state, "streak_state", batch_id)
            return
        first, last = span
        deltas = self._recent("rollup", ROLLUP, first - REACH, last)
        rollup = stage(merge_rollups(deltas, deltas.where(F.lit(False))).withColumn("minute", minute_of()), "recent")
        deltas = self._recent("declines", DECLINES, first - REACH, last)
        declines = merge_decline_rollups(deltas, deltas.where(F.lit(False))).withColumn("minute", minute_of())

        now = all_readings(rollup, self.merchants, self.coverage).where(F.col("minute") >= first)
        counted = stage(continue_streaks(R.confident(now), streak_state), "streaks")
        confirmed = stage(signals(promoted(counted, self.windows), rollup), "signals")
        thin = R.gaps(now)
        live = live_incidents(self._state("incident_log", LOG_SCHEMA, batch_id).drop("batch_id"))
        shown = self._evidence(confirmed, rollup, declines)
        log = incident_log(shown, thin, first, last, live)

        self.store.write(confirmed, "signals", batch_id)
        self.store.write(thin, "gaps", batch_id)
        self.store.write(shown, "evidence", batch_id)
        self.store.write(log, "incident_log", batch_id)
        state = stage(carry_over(streak_state, counted), "state")
        self.store.write(state, "streak_state", batch_id)
        self.store.write(state.where(F.col("streak") < self.windows), "pending", batch_id)
        since = F.timestamp_seconds(F.lit((last - RECENT_BUCKETS + 1) * 60))
        whole = S.portfolio_series(rollup, since).withColumn("provider_id", F.lit(None).cast("string"))
        self.store.write(S.provider_series(rollup, since).unionByName(whole), "snapshot", batch_id)
        self.store.write(self.spark.range(1).select(F.lit(last).cast("bigint").alias("minute")), "cursor", batch_id)
