"""Long-lived incidents: which one a window's evidence belongs to, and when it ends."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from dipwatch.constants import FREE_DIMS, RECALL_LIMIT, RESOLVE_AFTER_QUIET_MIN, ROOT_DIMS
from dipwatch.functions.cells import cell_key, compatible, specificity
from dipwatch.functions.minutes import block_of, bucket_of
from dipwatch.session import stage

LOG_SCHEMA = (
    "merchant_id string, country string, minute long, seq long, incident_id string, action string,"
    " request_id string, provider_id string, payment_method string, issuer_id string"
)
SESSION_LOG = LOG_SCHEMA + ", session long"
RESTORE, TICK = -1, 1
#: Session of what an earlier run left.
EARLIER = -1


def live_incidents(log: DataFrame) -> DataFrame:
    """Unresolved incidents as the log leaves them: what a later run has to continue from."""
    when = F.struct("minute", "seq")
    seen = F.col("action").isin("opened", "updated", "refreshed")
    last = log.groupBy("incident_id", *ROOT_DIMS).agg(
        F.max_by(F.struct("action", *FREE_DIMS), when).alias("l"), F.max(F.when(seen, F.col("minute"))).alias("minute")
    )
    return last.where(F.col("l.action") != "resolved").select(
        "incident_id", *ROOT_DIMS, *[F.col(f"l.{d}").alias(d) for d in FREE_DIMS], "minute", F.col("l.action").alias("status")
    )


def evidence_sessions(evidence: DataFrame) -> DataFrame:
    """Every minute of a root with evidence, and its session: the first minute of the stretch without a quiet spell it is in.

    A spell is quiet if all incidents last seen before it are due within it, so that evidence after it meets none of them, but for
    those that became inconclusive. Whether a minute begins a session shows in the minutes just before it (an equi-join); the
    running maximum of beginnings is taken within days first and then over one row a day, so no task holds a root's whole history.
    """
    minutes = evidence.select(*ROOT_DIMS, "minute").distinct()
    after = minutes.select(*ROOT_DIMS, F.explode(F.sequence(F.col("minute") + 1, F.col("minute") + RESOLVE_AFTER_QUIET_MIN)).alias("minute"))
    joined = minutes.join(after.distinct().withColumn("_near", F.lit(True)), [*ROOT_DIMS, "minute"], "left")
    begun = joined.select(
        *ROOT_DIMS, "minute", F.when(F.col("_near").isNull(), F.col("minute")).alias("_start"), block_of(F.col("minute")).alias("_day"))
    inside = Window.partitionBy(*ROOT_DIMS, "_day").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    begun = begun.withColumn("_own", F.max("_start").over(inside))
    days = begun.groupBy(*ROOT_DIMS, "_day").agg(F.max("_start").alias("_last"))
    earlier = Window.partitionBy(*ROOT_DIMS).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_carried", F.max("_last").over(earlier)).drop("_last")
    return begun.join(days, [*ROOT_DIMS, "_day"]).select(*ROOT_DIMS, "minute", F.coalesce("_own", "_carried").alias("session"))


def fold_events(evidence: DataFrame, gaps: DataFrame, first, last, live: DataFrame | None = None) -> DataFrame:
    """Everything the fold reads, in one table, with the session of each row.

    The clock runs over every minute of ``[first, last]``, with traffic or
    without. An incident last seen at minute m can only change by itself at
    m + 3, or at ``first`` if that is later, so instead of pairing every root
    with every minute the clock is one tick per evidence minute. A tick carries
    the keys of the root's gap cells in its minute. ``live`` holds the
    incidents of an earlier run; their rows come first.
    """
    order = Window.partitionBy("bucket", *ROOT_DIMS).orderBy(F.desc("priority_score"), "cell_key")
    sessions = evidence_sessions(evidence)
    shown = evidence.select(
        *ROOT_DIMS, "minute", F.lit(0).alias("kind"), F.row_number().over(order).cast("long").alias("ord"), "request_id",
        *FREE_DIMS,
        F.sha2(F.concat_ws("|", "merchant_id", "country", F.col("minute").cast("string"), "cell_key"), 256).alias("new_id"),
        F.array().cast("array<string>").alias("gap_cells"),
    ).join(sessions, [*ROOT_DIMS, "minute"])
    watched = sessions
    if live is not None:
        watched = watched.unionByName(live.select(*ROOT_DIMS, "minute", F.lit(EARLIER).cast("bigint").alias("session")))
    tick = F.greatest(F.col("minute") + RESOLVE_AFTER_QUIET_MIN, F.lit(first)).cast("bigint")
    due = watched.select(*ROOT_DIMS, "session", tick.alias("minute")).where(F.col("minute") <= F.lit(last)).groupBy(*ROOT_DIMS, "minute").agg(
        F.max("session").alias("session"))
    thin = gaps.groupBy(*ROOT_DIMS, "minute").agg(F.collect_set("cell_key").alias("gap_cells"))
    ticks = due.join(thin, [*ROOT_DIMS, "minute"], "left").select(
        *ROOT_DIMS, "minute", F.lit(TICK).alias("kind"), F.lit(0).cast("long").alias("ord"),
        F.lit(None).cast("string").alias("request_id"), *[F.lit(None).cast("string").alias(d) for d in FREE_DIMS],
        F.lit(None).cast("string").alias("new_id"),
        F.coalesce("gap_cells", F.array().cast("array<string>")).alias("gap_cells"), "session",
    )
    events = shown.select(*ticks.columns).unionByName(ticks)
    if live is None:
        return events
    return events.unionByName(live.select(
        *ROOT_DIMS, "minute", F.lit(RESTORE).alias("kind"), F.lit(0).cast("long").alias("ord"), F.col("status").alias("request_id"),
        *FREE_DIMS, F.col("incident_id").alias("new_id"), F.array().cast("array<string>").alias("gap_cells"),
        F.lit(EARLIER).cast("bigint").alias("session"),
    ))


def _key(root, cell) -> str:
    merchant, country = root
    provider, method, issuer = cell
    pairs = (("country", country), ("issuerId", issuer), ("merchantId", merchant), ("paymentMethod", method),
             ("providerId", provider))
    return "|".join(f"{name}={value}" for name, value in pairs if value is not None)


def _agree(a, b) -> bool:
    return all(x is None or y is None or x == y for x, y in zip(a, b))


def _fixed(cell) -> int:
    return sum(v is not None for v in cell)


class Walk:
    """The rules of one root: its unresolved incidents and, in ``log``, what happened to them. Events come in order."""

    def __init__(self, root, live: list[dict] | None = None, seq: int = 0):
        self.root, self.live, self.seq, self.log = root, live or [], seq, []

    def note(self, incident: dict, minute: int, action: str, request_id: str | None = None) -> None:
        self.seq += 1
        self.log.append((*self.root, minute, self.seq, incident["id"], action, request_id, *incident["cell"]))

    def evidence(self, minute: int, cell: tuple, request_id: str, new_id: str) -> None:
        fits = [i for i in self.live if _agree(i["cell"], cell)]
        best = max(fits, key=lambda i: (_fixed(i["cell"]), i["seen"]), default=None)
        if best is None:
            best = {"id": new_id, "cell": cell, "seen": minute, "status": "open"}
            self.live.append(best)
            self.note(best, minute, "opened", request_id)
            return
        best["seen"], best["status"] = minute, "monitoring"
        if _fixed(best["cell"]) > _fixed(cell):
            self.note(best, minute, "refreshed", request_id)
        else:
            best["cell"] = cell
            self.note(best, minute, "updated", request_id)

    def tick(self, minute: int, thin: set[str]) -> None:
        for incident in list(self.live):
            if incident["status"] == "inconclusive" or minute - incident["seen"] < RESOLVE_AFTER_QUIET_MIN:
                continue
            if _key(self.root, incident["cell"]) in thin:
                incident["status"] = "inconclusive"
                self.note(incident, minute, "inconclusive")
            else:
                self.live.remove(incident)
                self.note(incident, minute, "resolved")


def _fold(batches: Iterator[pd.DataFrame], chained: bool) -> Iterator[pd.DataFrame]:
    """Walk ordered events, holding only unresolved incidents.

    Each session is on its own, or (``chained``) the sessions of a root follow each other; then those that meet no incident of
    an earlier one are passed over, unless they are marked as leaving some themselves.
    """
    names = [part.split()[0] for part in SESSION_LOG.split(",")]
    walk, session, over = Walk(None), None, False
    for batch in batches:
        out = []
        for e in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
            root, minute = (e.merchant_id, e.country), int(e.minute)
            if root != walk.root or not chained and e.session != session:
                walk, session, over = Walk(root), None, False
            if session is None or e.session > session:
                session = e.session
                over = chained and not walk.live and not e.marked
            if over:
                continue
            cell = (e.provider_id, e.payment_method, e.issuer_id)
            if e.kind == TICK:
                walk.tick(minute, set(e.gap_cells))
            elif e.kind == RESTORE:
                walk.live.append({"id": e.new_id, "cell": cell, "seen": minute, "status": e.request_id})
            else:
                walk.evidence(minute, cell, e.request_id, e.new_id)
            out += [(*row, session) for row in walk.log]
            walk.log.clear()
        yield pd.DataFrame(out, columns=names)


def _plain_sessions(events: DataFrame) -> DataFrame:
    """Sessions with evidence of one cell only need no walk: the first row opens, the others update, and the last tick ends it."""
    by = [*ROOT_DIMS, "session"]
    order = Window.partitionBy(*by).orderBy("minute", "kind", "ord")
    ends = Window.partitionBy(*by).orderBy("minute", "kind", "ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cell = [F.first(d).over(ends).alias(d) for d in FREE_DIMS]
    rows = events.select(
        *by, "minute", "kind", "request_id", "gap_cells", F.row_number().over(order).cast("long").alias("seq"),
        F.first("new_id").over(ends).alias("incident_id"), F.max(F.when(F.col("kind") == 0, F.col("minute"))).over(ends).alias("_seen"), *cell,
    )
    key = cell_key()
    shown = F.col("kind") == 0
    action = (
        F.when(shown & (F.col("seq") == 1), "opened").when(shown, "updated")
        .when(F.array_contains("gap_cells", key), "inconclusive").otherwise("resolved")
    )
    return rows.where(shown | (F.col("minute") >= F.col("_seen") + RESOLVE_AFTER_QUIET_MIN)).withColumn("action", action).select(
        *[part.split()[0] for part in SESSION_LOG.split(",")])


def _ordered(events: DataFrame, *by: str) -> DataFrame:
    return events.repartition(*by).sortWithinPartitions(*by, "minute", "kind", "ord")


def incident_log(evidence: DataFrame, gaps: DataFrame, first, last, live: DataFrame | None = None) -> DataFrame:
    """What happened to every incident in the minutes ``[first, last]``, one row per event.

    The rules are sequential per root, but only from one quiet spell to the next. So a root's history is cut into sessions, each
    on its own: those of a single cell by windows, the others by walking their events in order. An incident that became inconclusive
    stays live over a quiet spell; of the roots with such a one, the sessions from there on are walked again in turn, and
    those that meet a live incident replace what was found for them alone. Events stream through a task; memory holds unresolved
    incidents only. With ``live``, the incidents of an earlier run (a micro-batch), the few minutes of each root are walked in turn.
    """
    events = fold_events(evidence, gaps, first, last, live)
    out = [part.split()[0] for part in LOG_SCHEMA.split(",")]
    if live is not None:
        marked = events.withColumn("marked", F.lit(True))
        return _ordered(marked, *ROOT_DIMS).mapInPandas(partial(_fold, chained=True), SESSION_LOG).select(*out)
    by = [*ROOT_DIMS, "session"]
    events = stage(events, "events")
    cells = F.struct(*[F.coalesce(d, F.lit("")) for d in FREE_DIMS])
    plain = events.where("kind = 0").groupBy(*by).agg((F.min(cells) == F.max(cells)).alias("plain")).where("plain").select(*by)
    walked = _ordered(events.join(plain, by, "left_anti").withColumn("marked", F.lit(True)), *by)
    alone = stage(_plain_sessions(events.join(plain, by, "left_semi")).unionByName(
        walked.mapInPandas(partial(_fold, chained=False), SESSION_LOG)), "alone")
    ended = alone.groupBy(*by, "incident_id").agg(F.max_by("action", F.struct("minute", "seq")).alias("action"))
    left = ended.where("action = 'inconclusive'").select(*by).distinct().withColumn("marked", F.lit(True))
    since = left.groupBy(*ROOT_DIMS).agg(F.min("session").alias("since"))
    later = events.join(since, list(ROOT_DIMS)).where(F.col("session") >= F.col("since")).drop("since")
    later = later.join(left, by, "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    again = stage(_ordered(later, *ROOT_DIMS).mapInPandas(partial(_fold, chained=True), SESSION_LOG), "again")
    kept = alone.join(again.select(*by).distinct(), by, "left_anti")
    return kept.unionByName(again).select(*out)


MEASURED = ["fingerprint", "dominant_decline", "ci", "started_at", "started_at_exact", "expected_rate", "observed_rate",
            "lost_approvals", "cost_local", "cost_usd_minor", "cost_usd_per_min", "priority_score", "confidence",
            "causal_dimension", "dominant_family", "attempts", "consecutive_windows", "decline_mix", "expected_source",
            "delta_pp", "diagnosis_source"]


def incidents(log: DataFrame, evidence: DataFrame) -> DataFrame:
    """Current state of every incident, measured columns from the evidence that last wrote it."""
    when = F.struct("minute", "seq")
    wrote = F.col("action").isin("opened", "updated")
    seen = F.col("action").isin("opened", "updated", "refreshed")
    state = log.groupBy("incident_id", *ROOT_DIMS).agg(
        F.max_by("action", when).alias("last_action"),
        F.max(F.when(seen, F.col("minute"))).alias("detected_minute"),
        F.min("minute").alias("opened_minute"),
        F.max(F.when(F.col("action") == "resolved", F.col("minute"))).alias("resolved_minute"),
        F.max_by(
            F.when(wrote, F.struct("request_id", *FREE_DIMS)), F.when(wrote, when)
        ).alias("w"),
    )
    status = (
        F.when(F.col("last_action") == "opened", "open")
        .when(F.col("last_action").isin("updated", "refreshed"), "monitoring")
        .otherwise(F.col("last_action"))
    )
    flat = state.select(
        "incident_id", *ROOT_DIMS, status.alias("status"), bucket_of("detected_minute").alias("detected_at"),
        bucket_of("opened_minute").alias("opened_at"),
        F.when(F.col("last_action") == "resolved", bucket_of("resolved_minute")).alias("resolved_at"),
        F.col("w.request_id").alias("request_id"), *[F.col(f"w.{d}").alias(d) for d in FREE_DIMS],
    ).withColumn("cell_key", cell_key())
    return flat.join(evidence.select("request_id", *MEASURED), "request_id", "left")


def transitions(log: DataFrame) -> DataFrame:
    return log.where(F.col("action").isin("resolved", "inconclusive")).select(
        bucket_of("minute").alias("bucket"), "incident_id", F.col("action").alias("to_status")
    )


def stored_evidence(log: DataFrame, attachments: DataFrame) -> DataFrame:
    """Which evidence object each incident keeps once finished investigations are attached.

    ``attachments``: incident_id, minute, the cell, source, request_id. An
    attachment counts when its cell is compatible with, and at least as
    specific as, the incident's cell at that time. After an agent's object is
    in place neither a window nor a search result replaces it. The cell "at
    that time" is an as-of value: one window per incident, no range join.
    """
    wrote = log.where(F.col("action").isin("opened", "updated")).select(
        "incident_id", "minute", F.lit(0).alias("kind"), F.lit("beam_search").alias("source"), "request_id",
        F.struct(*FREE_DIMS).alias("now"), *[F.lit(None).cast("string").alias(d) for d in FREE_DIMS],
    )
    offered = attachments.select(
        "incident_id", "minute", F.lit(1).alias("kind"), "source", "request_id",
        F.lit(None).cast("struct<provider_id:string,payment_method:string,issuer_id:string>").alias("now"), *FREE_DIMS,
    )
    so_far = Window.partitionBy("incident_id").orderBy("minute", "kind", "request_id").rowsBetween(
        Window.unboundedPreceding, 0
    )
    rows = wrote.unionByName(offered).withColumn("held", F.last("now", ignorenulls=True).over(so_far)).where(
        F.col("held").isNotNull()
    ).select("*", *[F.col(f"held.{d}").alias(f"held_{d}") for d in FREE_DIMS])
    fits = compatible("", "held_", FREE_DIMS) & (specificity("", FREE_DIMS) >= specificity("held_", FREE_DIMS))
    counted = rows.where((F.col("kind") == 0) | fits)
    agent = F.col("source") == "agent"
    when = F.struct("minute", "kind", "request_id")
    return counted.groupBy("incident_id").agg(
        F.count(F.when(F.col("kind") == 1, 1)).alias("accepted"),
        F.max_by(F.when(agent, F.col("request_id")), F.when(agent, when)).alias("agent_request"),
        F.max_by("request_id", when).alias("last_request"),
    ).select(
        "incident_id", "accepted", F.coalesce("agent_request", "last_request").alias("evidence_request"),
        F.when(F.col("agent_request").isNotNull(), "agent").otherwise("beam_search").alias("diagnosis_source"),
    )


def recall(found: DataFrame, limit: int = RECALL_LIMIT) -> DataFrame:
    """Newest resolved incidents with the same fingerprint, the incident itself left out.

    Only the ``limit + 1`` newest per fingerprint can ever be needed, so a
    fingerprint that recurs endlessly is cut to that before it is joined.
    """
    newest = Window.partitionBy("fingerprint").orderBy(F.desc("detected_at"), "incident_id")
    past = found.where(F.col("status") == "resolved").withColumn("_place", F.row_number().over(newest)).where(
        F.col("_place") <= limit + 1
    ).select(
        "fingerprint", F.col("incident_id").alias("similar_id"), F.col("started_at").alias("similar_started_at"),
        F.col("resolved_at").alias("similar_resolved_at"), F.col("detected_at").alias("similar_detected_at"),
        F.col("dominant_decline").alias("similar_decline"), F.col("cost_usd_minor").alias("similar_cost"),
        (F.col("causal_dimension") if "causal_dimension" in found.columns else F.lit(None).cast("string")).alias("similar_dimension"),
    )
    joined = found.select("incident_id", "fingerprint").join(past, "fingerprint", "inner").where(
        F.col("incident_id") != F.col("similar_id")
    )
    mine = Window.partitionBy("incident_id").orderBy(F.desc("similar_detected_at"), "similar_id")
    # Fixed wording of the summary.
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    summary = F.concat(
        F.lit("Same cell was down from "), F.date_format("similar_started_at", iso), F.lit(" until "),
        F.coalesce(F.date_format("similar_resolved_at", iso), F.lit("unknown")), F.lit(", dominant decline "),
        F.coalesce("similar_decline", F.lit("none")), F.lit(", cost "), F.col("similar_cost").cast("string"),
        F.lit(" USD minor units."),
    )
    return joined.withColumn("place", F.row_number().over(mine)).where(F.col("place") <= limit).select(
        "incident_id", "fingerprint", "place", "similar_id", "similar_dimension", "similar_decline", summary.alias("summary")
    )


def with_playbook(rows: DataFrame, playbooks: DataFrame) -> DataFrame:
    """First playbook of the causal dimension that names the dominant family or none, else the first of the dimension."""
    dimension = F.when(F.col("causal_dimension") == "method", "payment_method").otherwise(F.col("causal_dimension"))
    options = playbooks.withColumnRenamed("causal_dimension", "_dimension")
    joined = rows.withColumn("_dimension", dimension).join(options, "_dimension", "left")
    suits = F.coalesce(F.col("decline_family").isNull() | (F.col("decline_family") == F.col("dominant_family")), F.lit(False))
    place = Window.partitionBy("request_id").orderBy(F.desc(suits), "file_order")
    best = joined.withColumn("_place", F.row_number().over(place)).where("_place = 1")
    return best.withColumns({
        "actions": F.array("first_action", "second_action"),
        "human_approval_required": F.col("playbook_id").isNotNull(),
    }).drop("_place", "_dimension", "file_order", "decline_family", "first_action", "second_action")


ACTIVE = ("open", "monitoring")


def active(found: DataFrame) -> DataFrame:
    return found.where(F.col("status").isin(*ACTIVE))


def closed(found: DataFrame) -> DataFrame:
    return found.where(~F.col("status").isin(*ACTIVE))


def live_candidates(found: DataFrame) -> DataFrame:
    """Incidents evidence can still attach to."""
    return found.where(F.col("status") != "resolved")


def newest(found: DataFrame, limit: int) -> DataFrame:
    return found.orderBy(F.desc("detected_at"), "incident_id").limit(limit)


def unresolved(found: DataFrame, limit: int) -> DataFrame:
    return newest(found.where(F.col("resolved_at").isNull()), limit)


def latest_evidence(arrived: DataFrame, limit: int | None = None) -> DataFrame:
    """Last arrival per (fingerprint, bucket); with ``limit`` only the newest ones, newest first."""
    place = Window.partitionBy("fingerprint", "bucket").orderBy(F.desc("arrival"))
    kept = arrived.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")
    return kept if limit is None else kept.orderBy(F.desc("arrival")).limit(limit)
