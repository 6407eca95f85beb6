import json

import pytest
from pyspark.sql import functions as F

from dipwatch import catalogs as C
from dipwatch.operators import audit
from dipwatch.operators.faults import cell_grid, label_faults
from dipwatch.operators.report import minutes_since, money, signed_pp, tier_of
from dipwatch.operators.requests import invalid_reason
from dipwatch.operators.rollup import keep_since, minute_rollup
from dipwatch.session import stage_path
from dipwatch.sources import raw
from dipwatch.sources.raw import known_only, parse_events, parsed
from dipwatch.streaming.ingest import PAYMENT_ORDER, Store, bucket_plan, deduplicated, ingest_batch, payload_stream, run_available, stored_rollup

GOOD = {
    "transactionId": "3f2b1c4d-5e6f-4a7b-8c9d-0e1f2a3b4c5d", "merchantOrderId": "o1", "merchantId": "BR_STORE_01", "providerId": "stripe",
    "country": "BR", "paymentMethod": "CARD", "currency": "BRL", "amountMinor": 1000, "fxRate": 0.18, "fxRateDate": "2026-08-30",
    "fxSource": "PTAX", "amountUsdMinor": 180, "status": "SUCCESS", "issuerId": "itau", "createdAt": "2026-08-30T14:06:07.123Z",
}


def broken(spark, *payloads):
    rows = [(i, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    return [(r.reject_reason, list(r.broken_rules or [])) for r in parsed(spark.createDataFrame(rows, "id bigint, payload string")).orderBy("id").collect()]


def with_(**changes):
    return {k: v for k, v in {**GOOD, **changes}.items() if v != "drop"}


def test_reject_reasons(spark):
    got = broken(spark, GOOD, None, "", "{oops", "null", "[]")
    assert [r for r, _ in got] == [None, "missing_payload", "missing_payload", "bad_json", "schema", "schema"]


@pytest.mark.parametrize("rule, changes", [
    ("transactionId", {"transactionId": "123"}), ("merchantId", {"merchantId": ""}), ("merchantId", {"merchantId": 7}),
    ("country", {"country": "US"}), ("amountMinor", {"amountMinor": -1}), ("amountMinor", {"amountMinor": 1.5}),
    ("amountMinor", {"amountMinor": "10"}), ("fxRate", {"fxRate": 0}), ("fxRateDate", {"fxRateDate": "30/08/2026"}),
    ("fxSource", {"fxSource": "drop"}), ("cardBin", {"cardBin": "12345"}), ("cardType", {"cardType": "prepaid"}),
    ("latencyMs", {"latencyMs": -5}), ("createdAt", {"createdAt": "2026-08-30T14:06:07"}), ("issuerId", {"issuerId": None}),
    ("decline_iff_code", {"status": "DECLINED"}), ("decline_iff_code", {"declineCode": "05"}),
    ("pix_only_br", {"paymentMethod": "PIX", "country": "MX"}),
])
def test_each_rule(spark, rule, changes):
    assert broken(spark, with_(**changes)) == [("schema", [rule])]


def test_accepted_variants(spark):
    fine = [with_(status="DECLINED", declineCode="05"), with_(cardBin="123456", cardType="credit", latencyMs=12, token=None),
            with_(paymentMethod="PIX", issuerId="NA"), with_(createdAt="2026-08-30T11:06:07-03:00")]
    assert broken(spark, *fine) == [(None, [])] * 4


def test_quarantine_keeps_every_row_and_only_bad_rows_are_lost(spark):
    rows = [(0, json.dumps(GOOD)), (1, "{"), (2, json.dumps(with_(merchantId="UNKNOWN"))), (3, None)]
    clean, bad = parse_events(spark.createDataFrame(rows, "id bigint, payload string"))
    assert (clean.count(), bad.count()) == (2, 2)
    known, unknown = known_only(clean, {"merchant_id": C.merchants(spark).select("merchant_id"), "decline_code": C.decline_codes(spark).select("code")})
    assert [r.id for r in known.collect()] == [0] and [r.id for r in unknown.collect()] == [2]
    got = clean.where("id = 0").first()
    assert (got.transaction_id, got.amount_usd_minor, str(got.created_at)) == (GOOD["transactionId"], 180, "2026-08-30 14:06:07.123000")


def payments(spark, rows):
    base = "'BR_STORE_01' AS merchant_id, 'stripe' AS provider_id, 'BR' AS country, 'CARD' AS payment_method, 'itau' AS issuer_id"
    df = spark.createDataFrame(rows, "transaction_id string, second bigint, amount_minor bigint")
    return df.selectExpr(
        "transaction_id", "timestamp_seconds(1788098760 + second) AS created_at", *base.split(", "), "'SUCCESS' AS status",
        "cast(null AS string) AS decline_code", "amount_minor", "amount_minor AS amount_usd_minor")


def files(spark, name, *batches):
    path = stage_path(spark, name)
    for b in batches:
        payments(spark, b).coalesce(1).write.mode("append").parquet(path)
    return path


def test_redelivery_and_replay_leave_the_rollup_unchanged(spark):
    first, second = [("a", 1, 10), ("b", 2, 20), ("a", 1, 10)], [("b", 2, 20), ("c", 61, 30)]
    schema = payments(spark, first).schema
    path, base = stage_path(spark, "files"), stage_path(spark, "job")
    store = Store(spark, f"{base}/store")
    for batch in (first, second, second):
        payments(spark, batch).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        run_available(stream, f"{base}/checkpoint", ingest_batch(store, PAYMENT_ORDER))
    out = stored_rollup(store, minute_rollup(payments(spark, first)).schema).orderBy("bucket").collect()
    assert [(r.attempts, r.amount_minor_sum) for r in out] == [(2, 30), (1, 30)]
    # Running a batch id again overwrites its own output.
    ingest_batch(store, PAYMENT_ORDER)(payments(spark, second), 1)
    assert stored_rollup(store, minute_rollup(payments(spark, first)).schema).agg(F.sum("attempts")).first()[0] == 3


def test_state_bounded_dedup(spark):
    path = files(spark, "dup", [("a", 1, 10), ("b", 2, 20)], [("a", 1, 10), ("c", 3, 5)])
    out = stage_path(spark, "dedup")
    stream = spark.readStream.schema(payments(spark, [("a", 1, 1)]).schema).option("maxFilesPerTrigger", 1).parquet(path)
    run_available(deduplicated(stream), f"{out}/cp", lambda b, i: b.write.mode("overwrite").parquet(f"{out}/out/batch_id={i}"))
    assert sorted(r.transaction_id for r in spark.read.parquet(f"{out}/out").collect()) == ["a", "b", "c"]


def test_payload_stream_quarantines(spark):
    path, out = stage_path(spark, "json"), stage_path(spark, "parsed")
    spark.createDataFrame([(json.dumps(GOOD),), ("{",)], "value string").write.text(path)
    run_available(payload_stream(spark, path), f"{out}/cp", lambda b, i: b.select("id", "reject_reason").write.mode("overwrite").parquet(f"{out}/out/batch_id={i}"))
    assert sorted(str(r.reject_reason) for r in spark.read.parquet(f"{out}/out").collect()) == ["None", "bad_json"]


def test_retention_and_bucket_plan(spark):
    now = F.timestamp_seconds(F.lit(1788098760 + 60 * 20))
    df = payments(spark, [("a", 0, 1), ("b", 60 * 10, 1)])
    assert [r.transaction_id for r in keep_since(df, now, 15).collect()] == ["b"]
    assert keep_since(df, now, 0).count() == 2
    t = lambda m: F.timestamp_seconds(F.lit(m * 60))
    one = spark.range(1)
    size = lambda cursor, target, limit=None: one.select(F.size(bucket_plan(cursor, t(5), target, limit))).first()[0]
    none = F.lit(None).cast("timestamp")
    assert (size(none, t(50)), size(t(47), t(50)), size(t(50), t(50)), size(t(10), t(50))) == (46, 3, 0, 40)
    assert (size(none, t(50), 10), size(t(47), t(50), 10), size(t(10), t(50), 10)) == (10, 3, 10)


def test_faults_combine(spark):
    rows = [("x", 1, 5, 0, 600, None, 0.5, 10, {"05": 0.7}), ("y", 2, 0, 0, None, "itau", 0.5, None, {"05": 0.2, "51": 0.1}), ("z", 3, 0, 300, 900, "nubank", 0.0, 1, None)]
    df = spark.createDataFrame(rows, "fault_id string, place int, pad int, s bigint, e bigint, issuer_id string, conversion_multiplier double, latency_ms_increase bigint, decline_weights map<string,double>")
    df = df.withColumns({"starts_at": F.timestamp_seconds(F.col("s") + 1788098760), "ends_at": F.timestamp_seconds(F.col("e") + 1788098760),
                         **{d: F.lit(None).cast("string") for d in ("merchant_id", "provider_id", "country", "payment_method")}})
    got = {r.transaction_id: r for r in label_faults(payments(spark, [("in", 599, 1), ("edge", 600, 1), ("before", -1, 1)]), df).collect()}
    assert (got["in"].fault_ids, got["in"].conversion_multiplier, got["in"].latency_ms_increase) == (["x", "y"], 0.25, 10)
    assert got["in"].decline_weights == {"05": 0.2, "51": 0.1}
    assert got["edge"].fault_ids == ["y"] and got["before"].fault_ids == [] and got["before"].conversion_multiplier == 1.0


def test_grid_has_ninety_cells_and_weights_sum_to_one(spark, coverage, catalog):
    assert cell_grid(C.merchant_countries(spark), coverage, C.issuer_countries(spark)).count() == 90
    for r in catalog.groupBy("payment_method").agg(F.sum("baseline_share").alias("s")).collect():
        assert r.s == pytest.approx(1)


def test_slice_validity(spark):
    rows = [("M", "BR", "PIX", "NA", None), ("M", "MX", "PIX", None, "pix_outside_br"), ("M", "BR", "PIX", "itau", "pix_with_issuer"),
            (None, "BR", None, None, "merchant_required"), ("M", None, None, None, None)]
    df = spark.createDataFrame(rows, "merchant_id string, country string, payment_method string, issuer_id string, want string")
    for r in df.withColumn("got", invalid_reason()).collect():
        assert r.got == r.want


def test_number_grounding(spark):
    evidence = json.dumps({"rate": 0.125, "n": 300, "note": "codes 05 and 51", "k2": [0.5]})
    text = "At 12.5% (13%) of 300 with 05, then 50.0%; but 7 and -3 are new, 2 too"
    bad = audit.ungrounded_numbers(spark.createDataFrame([(1, text)], "id int, text string"),
                                   audit.allowed_from_json(spark.createDataFrame([(1, evidence)], "id int, evidence string")))
    assert sorted(r.number for r in bad.collect()) == ["-3", "2", "7"]


def test_step_audits(spark):
    steps = spark.createDataFrame([
        ("r", 1, "run_residual_test", "completed", "{}", None, []), ("r", 2, "scan_incident_onset", "failed", None, "TIMEOUT", [1]),
        ("r", 3, "x", "completed", None, None, [2, 3, 1]),
    ], "run_id string, step_no int, tool_name string, status string, tool_result string, error_code string, evidence_step_nos array<int>")
    refs = {(r.step_no, r.ref, r.reason) for r in audit.bad_references(steps).collect()}
    assert refs == {(3, 2, "unavailable_step"), (3, 3, "future_step")}
    runs = spark.createDataFrame([("r", "CONCLUSIVE", "running", [1, 2, 9])], "run_id string, conclusion string, status string, supporting_step_nos array<int>")
    weak = {(r.reason, r.detail) for r in audit.unsupported_conclusions(runs, steps).collect()}
    assert weak == {("incomplete_step", "2"), ("missing_step", "9"), ("missing_tool", "scan_incident_onset"), ("missing_tool", "estimate_incident_impact")}
    assert audit.orphan_runs(runs).count() == 1
    assert [r.reason for r in audit.inconsistent_steps(steps).collect()] == ["completed_without_result"]


def test_formats(spark):
    one = spark.range(1)
    got = one.select(money(F.lit(123456)), money(F.lit(99900)), money(F.lit(100000)), signed_pp(F.lit(-2.04)), signed_pp(F.lit(3.0)), tier_of(F.lit(20000)),
                     tier_of(F.lit(3000)), tier_of(F.lit(2999)),
                     minutes_since(F.timestamp_seconds(F.lit(0)), F.lit(False), F.timestamp_seconds(F.lit(120)))).first()
    assert list(got) == ["US$ 1.2k", "US$ 999", "US$ 1.0k", "−2.0pp", "+3.0pp", "critical", "warn", "ok", "≈ 2 min ago"]


def test_payload_files_are_written_by_many_tasks_and_read_in_four_batches(spark, tmp_path, monkeypatch):
    from dipwatch.plans import queries as Q

    rows = [(i, i % 50 + 1, i % 10 + 1, 1, float(i % 90 + 1)) for i in range(1, 401)]
    lines = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(Q, "stage_path", lambda spark, name: f"{tmp_path}/{name}")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = Q.QUERIES["q75_payload_ingest"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert len(list(tmp_path.glob("payload-ingest/in/*.txt"))) == 16
    assert len(list(tmp_path.glob("payload-ingest/store/facts/batch_id=*"))) == 4
    once = broken(spark, *[r.payload for r in Q.damaged_payloads(Q.payments(spark, str(tmp_path))).collect()])
    facts = sum(reason is None for reason, _ in once)
    assert {r.outcome: r.entries for r in got}["fact"] == facts and sum(r.entries for r in got) == facts + 2 * (400 - facts)


def test_types_that_cannot_be_wrong_are_not_searched(spark):
    kinds = ("STRING", "VOID", "BIGINT", "DOUBLE", "DECIMAL(2,1)", "BOOLEAN", "ARRAY<VOID>", "OBJECT<token: BIGINT>", "OBJECT<x: STRING>")
    names = (*raw.TEXT_FIELDS, *raw.OPTIONAL_TEXT, "latencyMs", "amountMinor", "amountUsdMinor", "fxRate", "other")
    rows = [(f"OBJECT<{n}: {k}>",) for n in names for k in kinds] + [(f"OBJECT<amountMinor: BIGINT, {n}: {k}, fxRate: DOUBLE>",) for n in names for k in kinds]
    rows += [("VOID",), ("STRING",), ("ARRAY<OBJECT<token: BIGINT>>",), (None,)]
    types = spark.createDataFrame(rows, "types string").select("types", raw.may_be_mistyped().alias("may"), F.size(raw.mistyped()).alias("found"))
    assert types.where("found > 0 AND NOT may").count() == 0 and types.where("found > 0 AND may").count() > 200
    clean = "OBJECT<amountMinor: BIGINT, amountUsdMinor: BIGINT, fxRate: DECIMAL(2,1), latencyMs: BIGINT, token: VOID, transactionId: STRING>"
    assert not spark.createDataFrame([(clean,)], "types string").select(raw.may_be_mistyped()).first()[0]
