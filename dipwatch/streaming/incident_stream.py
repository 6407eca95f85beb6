"""Incidents as a stateful stream: evidence and gaps arrive in any order within the watermark, incidents are keyed state.

State of a root (merchant, country): rows not yet folded, unresolved incidents, a counter. Every minute with rows has an event-time timer;
when the watermark has passed it, no row of it can come any more, and all minutes passed are folded in order, with the ticks that
fall between them. An incident's own end, three minutes after it was last seen, is a timer too, so it needs no further traffic. The
rules are those of the batch (``operators.incidents.Walk``), so the stream's log equals the batch's over the same rows.

Bounds: a root holds its rows within the watermark's delay and its unresolved incidents, never its history.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dipwatch.constants import FREE_DIMS, RESOLVE_AFTER_QUIET_MIN, ROOT_DIMS
from dipwatch.operators.incidents import LOG_SCHEMA, Walk

EVIDENCE, GAP, CLOCK = "evidence", "gap", "clock"
ROWS = ("kind string, bucket timestamp, merchant_id string, country string, provider_id string, payment_method string, issuer_id string,"
        " cell_key string, priority_score double, request_id string, new_id string")
_WAITING = ("minute bigint, kind string, score double, cell_key string, provider_id string, payment_method string, issuer_id string,"
            " request_id string, new_id string")
_LIVE = "id string, provider_id string, payment_method string, issuer_id string, seen bigint, status string"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_rows(evidence: DataFrame, gaps: DataFrame) -> DataFrame:
    """Rows as the stream reads them."""
    new_id = F.sha2(F.concat_ws("|", "merchant_id", "country", F.col("minute").cast("string"), "cell_key"), 256)
    shown = evidence.select(
        F.lit(EVIDENCE).alias("kind"), "bucket", *ROOT_DIMS, *FREE_DIMS, "cell_key", "priority_score", "request_id", new_id.alias("new_id"))
    thin = gaps.select(
        F.lit(GAP).alias("kind"), "bucket", *ROOT_DIMS, *FREE_DIMS, "cell_key", F.lit(None).cast("double").alias("priority_score"),
        F.lit(None).cast("string").alias("request_id"), F.lit(None).cast("string").alias("new_id"))
    return shown.unionByName(thin)


def clock_row(spark: SparkSession, minute: int) -> DataFrame:
    """A row that says only that time has come to ``minute``; it belongs to no root."""
    row = spark.range(1).select(F.timestamp_seconds(F.lit(minute * 60)).alias("bucket"), F.lit(CLOCK).alias("kind"))
    names = [part.split()[:2] for part in ROWS.split(", ")]
    return row.select(*[n if n in ("kind", "bucket") else F.lit("" if n in ROOT_DIMS else None).cast(t).alias(n) for n, t in names])


def _text(value):
    return None if value is None or value != value else value


class IncidentProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.live = handle.getListState("live", _LIVE)
        self.seq = handle.getValueState("seq", "seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came, minutes = [], set()
        for part in rows:
            part = part[part["kind"] != CLOCK]
            at = (part["bucket"].astype("datetime64[s]").astype("int64") // 60).tolist()
            minutes.update(at)
            fields = [[_text(v) for v in part[c].tolist()] for c in ("kind", "priority_score", "cell_key", *FREE_DIMS, "request_id", "new_id")]
            came += list(zip(at, *fields))
        if came:
            self.waiting.appendList(came)
        for minute in minutes:
            self.handle.registerTimer(minute * 60_000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() // 60_000
        waiting = list(self.waiting.get())
        rows = [r for r in waiting if r[0] <= until]
        live = [{"id": i[0], "cell": tuple(i[1:4]), "seen": i[4], "status": i[5]} for i in self.live.get()]
        if not rows and not any(i["status"] != "inconclusive" and i["seen"] + RESOLVE_AFTER_QUIET_MIN <= until for i in live):
            return
        seq = self.seq.get()
        walk = Walk(tuple(key), live, seq[0] if seq else 0)
        shown, thin = {}, {}
        for r in rows:
            if r[1] == EVIDENCE:
                shown.setdefault(r[0], []).append(r)
            else:
                thin.setdefault(r[0], set()).add(r[3])
        ticks = {max(0, i["seen"]) + RESOLVE_AFTER_QUIET_MIN for i in live if i["status"] != "inconclusive"}
        for minute in _ascending(set(shown) | ticks, until):
            for r in sorted(shown.get(minute, ()), key=lambda r: (-r[2], r[3])):
                walk.evidence(minute, tuple(r[4:7]), r[7], r[8])
            walk.tick(minute, thin.get(minute, set()))
        kept = [r for r in waiting if r[0] > until]
        self.waiting.put(kept) if kept else self.waiting.clear()
        left = [(i["id"], *i["cell"], i["seen"], i["status"]) for i in walk.live]
        self.live.put(left) if left else self.live.clear()
        self.seq.update((walk.seq,))
        for minute in {i["seen"] + RESOLVE_AFTER_QUIET_MIN for i in walk.live if i["status"] != "inconclusive"}:
            if minute > until:
                self.handle.registerTimer(minute * 60_000)
        if walk.log:
            yield pd.DataFrame(walk.log, columns=[part.split()[0] for part in LOG_SCHEMA.split(",")])

    def close(self) -> None:
        pass


def _ascending(minutes: set[int], until: int) -> Iterator[int]:
    """The minutes up to ``until`` with, after each, the one in which an incident seen in it is due."""
    todo, done = set(minutes), None
    while todo:
        minute = min(todo)
        todo.discard(minute)
        if minute > until:
            return
        if minute == done:
            continue
        done = minute
        if minute in minutes:
            todo.add(minute + RESOLVE_AFTER_QUIET_MIN)
        yield minute


def streaming_incidents(rows: DataFrame, delay: str) -> DataFrame:
    """The incident log of a stream of ``ROWS``; ``delay``: how late a row may come."""
    return rows.withWatermark("bucket", delay).groupBy(*ROOT_DIMS).transformWithStateInPandas(
        IncidentProcessor(), LOG_SCHEMA, "Append", "EventTime")


def run_incidents(rows: DataFrame, path: str, delay: str) -> None:
    """Fold all there is into parquet under ``path``/log. The state store is set for this query only."""
    spark, name = rows.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _PROVIDER)
    try:
        run = streaming_incidents(rows, delay).writeStream.format("parquet").option("path", f"{path}/log").option(
            "checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    run.awaitTermination()
