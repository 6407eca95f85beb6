import pytest
from pyspark.sql import functions as F

from dipwatch import catalogs as C
from dipwatch.constants import DIMS
from dipwatch.functions.cells import cell_key
from dipwatch.operators.evidence import evidence, evidence_json, trail
from dipwatch.operators.incidents import with_playbook
from dipwatch.operators.mix import decline_shifts, dominant, outage_attribution, window_totals
from dipwatch.operators.report import report
from dipwatch.operators.requests import incident_impact
from dipwatch.plans.diagnose import accept_rescues, diagnose
from tests.grids import DECLINES, NOON, br_dual, br_flat, br_full, cell, frame, key, mx_issuer

BR = dict(country="BR", merchant_id="BR_STORE_01")
SIGNAL = ("minute bigint, split string, merchant_id string, provider_id string, country string, payment_method string, issuer_id string,"
          " observed_rate double, expected_rate double, expected_source string, delta_pp double, ci_low double, ci_high double,"
          " attempts bigint, approved bigint, window_used string, consecutive_windows bigint")
REQUEST = ("request_id string, minute bigint, merchant_id string, provider_id string, country string, payment_method string,"
           " issuer_id string")


def signal(split="root", streak=3, minute=NOON, **dims):
    return (minute, split, *cell(**dims), 0.7, 0.9, "absolute", 3.0, 0.65, 0.75, 1400, 1078, "1m", streak)


def signals(spark, rows):
    return frame(spark, rows, SIGNAL).withColumn("cell_key", cell_key())


@pytest.fixture(scope="module")
def run(spark, coverage, catalog):
    rates = spark.createDataFrame([("BR_STORE_01", 0.9, 3.0), ("MX_STORE_01", 0.91, 3.0)],
                                  "merchant_id string, expected_conversion double, delta_pp double")

    def go(rows, found, declines=()):
        d = frame(spark, list(declines), DECLINES)
        return diagnose(signals(spark, found), frame(spark, rows), d, rates, coverage, catalog)
    return go


def test_both_causes_ranked_by_money(run):
    out = run(br_full() + mx_issuer(), [signal(**BR), signal(country="MX", merchant_id="MX_STORE_01")])
    rows = out.withColumn("key", cell_key()).orderBy(F.desc("priority_score")).collect()
    assert [r.key for r in rows] == [
        key(**BR, provider_id="adyen", payment_method="CARD", issuer_id="itau"),
        key(country="MX", merchant_id="MX_STORE_01", issuer_id="bbva_mx"),
    ]
    first = rows[0]
    assert (first.lost_approvals, first.avg_ticket_usd_minor, first.cost_usd_minor) == (243, 10_000, 2_430_000)
    assert first.cost_local == {"BRL": 12_150_000} and first.currency == "BRL"
    assert {r.confidence for r in rows} == {"CONFIRMED"} and first.expected_source == "cross_sectional"
    assert key(**BR, provider_id="adyen") in [e.key for e in first.echoes]


def test_flat_drop_reports_the_root_signal(run):
    out = run(br_flat(), [signal(**BR), signal("provider", 7, **BR, provider_id="adyen")]).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.confidence, r.causal_dimension, r.expected_source, r.attempts, r.consecutive_windows) == (
        "INCONCLUSIVE", "merchant", "absolute", 1400, 7)
    assert r.provider_id is None and r.explained_deficit == pytest.approx(1400 * 0.9 - 1078)


def test_signal_the_peel_cannot_reach_is_rescued(run):
    found = [signal(**BR), signal("provider", **BR, provider_id="stripe"), signal("provider", **BR, provider_id="adyen"),
             signal("issuer", **BR, payment_method="CARD", issuer_id="nubank")]
    out = run(br_dual(), found).withColumn("key", cell_key()).collect()
    got = {r.origin: r.key for r in out}
    assert got["peel"] == key(**BR, provider_id="stripe", payment_method="CARD", issuer_id="itau")
    assert got["rescue"] == key(**BR, provider_id="adyen", payment_method="CARD", issuer_id="nubank")
    assert len(out) == 2


def test_rescues_are_taken_in_order(spark):
    """The accepted cause of one signal silences a later compatible one, not an incompatible one."""
    asked = signals(spark, [signal("provider", **BR, provider_id="adyen"), signal("issuer", **BR, payment_method="CARD", issuer_id="nubank"),
                            signal("issuer", **BR, payment_method="CARD", issuer_id="itau")]).withColumn("pid", F.col("cell_key"))
    a, n, i = (r.pid for r in asked.orderBy("split", "pid").collect()[-1:] + asked.where("issuer_id = 'nubank'").collect() + asked.where("issuer_id = 'itau'").collect())
    found = spark.createDataFrame([
        (a, 1, "k1", "adyen", "CARD", "nubank"), (n, 1, "k2", "stripe", "CARD", "nubank"), (i, 1, "k3", "stripe", "CARD", "itau"),
        (i, 2, "k1", "adyen", "CARD", "nubank"),
    ], "pid string, peel_no int, key string, provider_id string, payment_method string, issuer_id string")
    got = {(r.pid, r.peel_no) for r in accept_rescues(asked, found).collect()}
    assert got == {(a, 1), (i, 1)}


def declined(code, n, minute=NOON, provider="adyen", issuer="itau", method="CARD"):
    return (minute, "BR_STORE_01", provider, "BR", method, issuer, code, n)


def ask(spark, **dims):
    return frame(spark, [("r", NOON, *cell(**BR, **dims))], REQUEST)


def mix(spark, catalog, rows, **dims):
    return decline_shifts(frame(spark, rows, DECLINES), ask(spark, **dims), catalog)


def test_share_that_moved(spark, catalog):
    s = mix(spark, catalog, [declined("05", 78), declined("51", 20), declined("91", 2)])
    r = {x.code: x for x in s.collect()}
    assert (r["05"].total_declines, r["05"].window_min) == (100, 1)
    assert (r["05"].observed_share, r["05"].reference_share) == (0.78, 0.32) and r["05"].moved_pp == pytest.approx(46)
    assert dominant(s).first().dominant_code == "05"


def test_window_widens_and_unknown_codes_count_in_the_total(spark, catalog):
    rows = [declined(c, n, NOON - i, method="PIX", issuer="NA") for i in range(5) for c, n in (("AM05", 3), ("AB03", 2))]
    s = mix(spark, catalog, rows, payment_method="PIX")
    assert {(x.window_min, x.total_declines) for x in s.collect()} == {(5, 25)}
    assert dominant(s).first().dominant_code == "AB03"
    s = mix(spark, catalog, [declined("05", 10), declined("??", 90)])
    assert [(x.code, x.total_declines) for x in s.collect()] == [("05", 100)]
    totals = window_totals(frame(spark, [declined("??", 90)], DECLINES), ask(spark)).first()
    assert (totals.window_min, totals.total_declines, totals.reference_source) == (1, 90, "catalog")


@pytest.mark.parametrize("rows", [[("51", 11), ("05", 7), ("91", 2)], [("51", 90), ("05", 10)]])
def test_no_dominant_without_support(spark, catalog, rows):
    assert dominant(mix(spark, catalog, [declined(*r) for r in rows])).count() == 0


def test_own_history_replaces_the_catalogue(spark, catalog):
    rows = [declined("05", 60, NOON - 60), declined("51", 60, NOON - 60), declined("05", 90), declined("51", 10)]
    r = {x.code: x for x in mix(spark, catalog, rows).collect()}
    assert (r["05"].reference_source, r["05"].reference_share) == ("temporal", 0.5) and r["05"].moved_pp == pytest.approx(40)


@pytest.mark.parametrize("rows, verdict", [
    ([("adyen", "itau"), ("adyen", "nubank"), ("adyen", "bradesco")], "PROVIDER"),
    ([("adyen", "itau"), ("stripe", "itau"), ("mercado_pago", "itau")], "ISSUER"),
    ([("adyen", "itau")], "INCONCLUSIVE"), ([], "INCONCLUSIVE"),
])
def test_outage_spread(spark, rows, verdict):
    d = frame(spark, [declined("91", 5, provider=p, issuer=i) for p, i in rows] + [declined("05", 5)], DECLINES)
    scope = spark.createDataFrame([("r", "BR_STORE_01", "BR", NOON, 1, "91")],
                                  "request_id string, merchant_id string, country string, minute bigint, window_min int, code string")
    assert outage_attribution(d, scope).first().attribution == verdict


def test_rail_outage(spark):
    d = frame(spark, [declined("AB03", 5, provider=p, issuer="NA", method="PIX") for p in ("adyen", "stripe")], DECLINES)
    scope = spark.createDataFrame([("r", "BR_STORE_01", "BR", NOON, 1, "AB03")],
                                  "request_id string, merchant_id string, country string, minute bigint, window_min int, code string")
    assert outage_attribution(d, scope).first().attribution == "RAIL"


def test_impact_over_three_minutes(spark):
    rows = [x for m in range(3) for x in br_full(NOON - m)]
    req = ask(spark, provider_id="adyen", payment_method="CARD", issuer_id="itau").withColumns(
        {"started_minute": F.lit(NOON - 2).cast("bigint"), "expected": F.lit(0.95)})
    r = incident_impact(frame(spark, rows), req).first()
    assert (r.duration_min, r.lost_approvals, r.cost_usd_minor) == (3, 746, 7_460_000)


def test_evidence_trail_report(spark, run):
    rows, declines = br_full(), [declined("05", 200), declined("51", 30)]
    found = run(rows, [signal(**BR)], declines)
    ev = evidence(found)
    e = ev.first()
    place = key(**BR, provider_id="adyen", payment_method="CARD", issuer_id="itau")
    assert e.fingerprint == place + "#05" and e.diagnosis_source == "beam_search"
    assert all(x.residual_rate is not None for x in e.suppressed_echoes)
    assert '"fingerprint"' in evidence_json(ev).first().evidence
    steps = trail(found, frame(spark, rows)).orderBy("step_no").collect()
    assert [s.axis for s in steps] == ["provider_id", "payment_method", "issuer_id", None, None]
    assert [list(s.evidence_step_nos) for s in steps] == [[], [1], [2], [3], [4]]
    assert steps[0].rates["adyen"] == pytest.approx(316 / 600)
    text = report(ev, C.playbooks(spark)).first()
    assert text.label == "Adyen · Brazil · CARD · Itau · Aurora Marketplace"
    assert "is confirmed at 10.0% against an expected 95.0% (vs. its siblings this window), over 300 attempts across 3 consecutive windows." in text.narrative_ops
    assert "Code 05 (Do not honor) rose from 32% to 87% of declines." in text.narrative_ops
    assert text.narrative_exec.startswith("Losing at least US$ 24.3k/min on Adyen") and "Recommended: issuer escalation." in text.narrative_exec
    assert with_playbook(ev, C.playbooks(spark)).first().playbook_id == "issuer-default"


def test_playbook_falls_back_to_the_dimension(spark):
    rows = [("a", "method", "issuer"), ("b", "method", "network"), ("c", "provider", None)]
    df = spark.createDataFrame(rows, "request_id string, causal_dimension string, dominant_family string")
    got = {r.request_id: r.playbook_id for r in with_playbook(df, C.playbooks(spark)).collect()}
    assert got == {"a": "method-country-default", "b": "method-country-default", "c": "provider-default"}
    assert DIMS[0] == "merchant_id"
