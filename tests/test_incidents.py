import random
from collections import defaultdict

from pyspark.sql import functions as F

from dipwatch.functions.cells import cell_key
from dipwatch.operators.incidents import (active, closed, evidence_sessions, incident_log, latest_evidence, live_candidates, live_incidents, recall, stored_evidence,
                                          transitions, unresolved)
from tests.grids import NOON, cell, frame, key

SCHEMA = ("minute bigint, merchant_id string, provider_id string, country string, payment_method string, issuer_id string,"
          " priority_score double, request_id string")
BR = dict(merchant_id="BR_STORE_01", country="BR")
ITAU = dict(BR, provider_id="stripe", payment_method="CARD", issuer_id="itau")
NUBANK = dict(BR, provider_id="adyen", payment_method="CARD", issuer_id="nubank")


def tables(spark, evidence, gaps, spine):
    ev = frame(spark, [(m, *cell(**c), float(p), f"{m}/{i}") for i, (m, p, c) in enumerate(evidence)], SCHEMA).withColumn("cell_key", cell_key())
    g = frame(spark, [(m, *cell(**c), 0.0, "") for m, c in gaps], SCHEMA).withColumn("cell_key", cell_key())
    return ev, g, min(spine), max(spine)


def log_of(spark, evidence, gaps=(), spine=range(NOON, NOON + 40)):
    return incident_log(*tables(spark, list(evidence), list(gaps), list(spine)))


def actions(log):
    return [(r.minute - NOON, r.action) for r in log.orderBy("minute", "seq").collect()]


def test_quiet_windows_resolve_and_a_gap_is_inconclusive(spark):
    assert actions(log_of(spark, [(NOON, 1, ITAU)])) == [(0, "opened"), (3, "resolved")]
    assert actions(log_of(spark, [(NOON, 1, ITAU)], [(NOON + 3, ITAU)])) == [(0, "opened"), (3, "inconclusive")]
    assert actions(log_of(spark, [(NOON, 1, ITAU)], [(NOON + 3, BR), (NOON + 2, ITAU)])) == [(0, "opened"), (3, "resolved")]
    # The clock ticks in every minute, also where there is no traffic, and not beyond the last one.
    assert actions(log_of(spark, [(NOON, 1, ITAU)], spine=[NOON, NOON + 1, NOON + 3000])) == [(0, "opened"), (3, "resolved")]
    assert actions(log_of(spark, [(NOON, 1, ITAU)], spine=[NOON, NOON + 2])) == [(0, "opened")]
    assert transitions(log_of(spark, [(NOON, 1, ITAU)])).first().to_status == "resolved"


def test_containment_decides_identity(spark):
    provider = dict(BR, provider_id="stripe", payment_method="CARD")
    assert actions(log_of(spark, [(NOON, 1, provider), (NOON + 1, 1, ITAU)]))[:2] == [(0, "opened"), (1, "updated")]
    assert actions(log_of(spark, [(NOON, 1, ITAU), (NOON + 1, 1, BR)]))[:2] == [(0, "opened"), (1, "refreshed")]
    two = log_of(spark, [(NOON, 2, ITAU), (NOON, 1, NUBANK)])
    assert actions(two)[:2] == [(0, "opened"), (0, "opened")] and two.select("incident_id").distinct().count() == 2
    # An inconclusive incident is attached to again and then resolves.
    again = log_of(spark, [(NOON, 1, ITAU), (NOON + 9, 1, ITAU)], [(NOON + 3, ITAU)])
    assert actions(again) == [(0, "opened"), (3, "inconclusive"), (9, "updated"), (12, "resolved")]


def test_live_incidents_close_in_a_later_run(spark):
    """What an earlier run left open is due at once if its time has passed, with minutes left out or days without traffic between."""
    left = live_incidents(log_of(spark, [(NOON, 1, ITAU)], spine=[NOON, NOON + 1]))
    for first in (NOON + 2, NOON + 31, NOON + 3000):
        ev, gaps, _, _ = tables(spark, [], [], [NOON])
        log = incident_log(ev, gaps, first, first + 5, left)
        assert actions(log) == [(max(3, first - NOON), "resolved")]


def by_hand(evidence, gaps, spine):
    """Brute force over every minute."""
    shown, thin, out, live = defaultdict(list), defaultdict(set), [], []
    for i, (m, p, c) in enumerate(evidence):
        if c is None:
            continue
        shown[m].append((-p, key(**c), c, f"{m}/{i}"))
    for m, c in gaps:
        thin[m].add(key(**c))
    dims = ("provider_id", "payment_method", "issuer_id")
    for now in range(min(spine), max(spine) + 1):
        for _, _, c, _ in sorted(shown[now], key=lambda x: x[:2]):
            fits = [x for x in live if all(not x["c"].get(d) or not c.get(d) or x["c"][d] == c[d] for d in dims)]
            if not fits:
                live.append({"c": c, "seen": now, "state": "open"})
                out.append((now, "opened", key(**c)))
                continue
            # Of equals, the one opened first.
            x = max(fits, key=lambda x: (len(x["c"]), x["seen"]))
            x["seen"], x["state"] = now, "monitoring"
            if len(x["c"]) <= len(c):
                x["c"] = c
                out.append((now, "updated", key(**c)))
            else:
                out.append((now, "refreshed", key(**x["c"])))
        for x in list(live):
            if x["state"] in ("open", "monitoring") and now - x["seen"] >= 3:
                if key(**x["c"]) in thin[now]:
                    x["state"] = "inconclusive"
                    out.append((now, "inconclusive", key(**x["c"])))
                else:
                    live.remove(x)
                    out.append((now, "resolved", key(**x["c"])))
    return sorted(out)


def test_fold_equals_brute_force(spark):
    rng = random.Random(5)
    cells = [BR, ITAU, NUBANK, dict(BR, provider_id="stripe"), dict(BR, payment_method="CARD", issuer_id="itau"), dict(BR, payment_method="PIX")]
    spine = sorted(rng.sample(range(NOON, NOON + 400), 300))
    evidence = [(m, rng.random(), c) for m in spine for c in rng.sample(cells, 2) if rng.random() < 0.12]
    gaps = [(m, c) for m in spine for c in cells if rng.random() < 0.2]
    log = log_of(spark, evidence, gaps, spine).withColumn("key", cell_key())
    assert sorted((r.minute, r.action, r.key) for r in log.collect()) == by_hand(evidence, gaps, spine)
    assert len({a for _, a, _ in by_hand(evidence, gaps, spine)}) == 5


def test_sessions_end_at_quiet_spells_and_cross_midnight(spark):
    day = NOON // 1440 * 1440 + 1440
    minutes = [day - 9, day - 5, day - 2, day + 1, day + 5, day + 2000, day + 2003, day + 2007]
    ev, *_ = tables(spark, [(m, 1, ITAU) for m in minutes], [], [NOON])
    got = {r.minute - day: r.session - day for r in evidence_sessions(ev).collect()}
    assert got == {-9: -9, -5: -5, -2: -5, 1: -5, 5: 5, 2000: 2000, 2003: 2000, 2007: 2007}


def test_fold_of_many_sessions_and_roots_equals_brute_force(spark):
    """Most sessions stand alone; inconclusive incidents reach over quiet spells of days, some for ever."""
    rng = random.Random(11)
    mx = dict(merchant_id="MX_STORE_01", country="MX")
    pools = {"BR": [BR, ITAU, NUBANK, dict(BR, provider_id="stripe")], "MX": [mx, dict(mx, provider_id="stripe"), dict(mx, payment_method="CARD")]}
    spine = range(NOON, NOON + 6000)
    evidence, gaps = [], []
    for country, pool in pools.items():
        at = NOON
        while at < NOON + 5900:
            some = rng.sample(pool, rng.choice([1, 1, 2, 3]))
            for m in range(at, at + rng.randrange(1, 9)):
                evidence += [(m, rng.random(), c) for c in some if rng.random() < 0.7]
            at += rng.choice([4, 5, 6, 12, 40, 700])
        gaps += [(m, c) for m in spine for c in pool if rng.random() < (0.03 if country == "BR" else 0.4)]
    log = log_of(spark, evidence, gaps, [min(spine), max(spine)]).withColumn("key", cell_key())
    want = [r for country in pools for r in by_hand([e if e[2]["country"] == country else (e[0], e[1], None) for e in evidence],
                                                    [g for g in gaps if g[1]["country"] == country], spine)]
    assert sorted((r.minute, r.action, r.key) for r in log.collect()) == sorted(want)
    first = log.groupBy("incident_id").agg(F.min("minute").alias("a"), F.max("minute").alias("b"), F.max(F.col("action") == "inconclusive").alias("c"))
    assert first.where("c AND b > a + 30").count() > 3


def test_agent_object_is_not_overwritten(spark):
    log = log_of(spark, [(NOON, 1, ITAU), (NOON + 1, 1, ITAU), (NOON + 2, 1, ITAU)])
    one = log.select("incident_id").first().incident_id
    schema = "incident_id string, minute bigint, source string, request_id string, provider_id string, payment_method string, issuer_id string"

    def kept(*offers):
        return stored_evidence(log, spark.createDataFrame([(one, NOON + m, s, r, *c) for m, s, r, c in offers], schema)).first()

    full = ("stripe", "CARD", "itau")
    r = kept((1, "agent", "a1", full), (2, "beam_search", "late", full))
    assert (r.evidence_request, r.diagnosis_source, r.accepted) == ("a1", "agent", 2)
    coarse = kept((1, "agent", "a1", ("stripe", None, None)))
    assert coarse.diagnosis_source == "beam_search" and coarse.accepted == 0
    assert kept((1, "agent", "a1", ("adyen", "CARD", "itau"))).accepted == 0
    assert kept((1, "agent", "a1", full), (2, "agent", "a2", full)).evidence_request == "a2"


def test_recall_lists_and_predicates(spark):
    rows = [(f"i{n}", "F", "resolved" if n else "open", n, None if n == 0 else n + 3) for n in range(6)] + [("x", "G", "resolved", 1, 4)]
    df = spark.createDataFrame(rows, "incident_id string, fingerprint string, status string, at int, over int").withColumns({
        "detected_at": F.timestamp_seconds(F.col("at") * 60), "started_at": F.timestamp_seconds(F.col("at") * 60),
        "resolved_at": F.timestamp_seconds(F.col("over") * 60), "dominant_decline": F.lit("05"), "cost_usd_minor": F.lit(7), "causal_dimension": F.lit("issuer"),
    })
    got = {(r.incident_id, r.place): r.similar_id for r in recall(df).collect()}
    assert [got[("i0", p)] for p in (1, 2, 3)] == ["i5", "i4", "i3"]
    assert [got[("i5", p)] for p in (1, 2, 3)] == ["i4", "i3", "i2"]
    assert not any(i == "x" for i, _ in got)
    assert {(r.similar_dimension, r.similar_decline) for r in recall(df).collect()} == {("issuer", "05")}
    assert (active(df).count(), closed(df).count(), live_candidates(df).count(), unresolved(df, 50).count()) == (1, 6, 1, 1)
    seen = spark.createDataFrame([("f", 1, 1, "old"), ("f", 1, 2, "new"), ("f", 2, 3, "other")], "fingerprint string, bucket int, arrival int, v string")
    assert [r.v for r in latest_evidence(seen, 9).collect()] == ["other", "new"] and latest_evidence(seen).count() == 2
