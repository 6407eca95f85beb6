"""Query catalogue: every registered query, as a function of a session and a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from dipwatch import catalogs as C
from dipwatch.constants import DIMS, FREE_DIMS, RECENT_BUCKETS, ROOT_DIMS
from dipwatch.functions.cells import cell_key, compatible, same_cell, specificity
from dipwatch.functions.minutes import block_of, blocks_between, bucket_of, calendar
from dipwatch.functions.stats import DROP, rate, with_verdict
from dipwatch.operators import audit, evidence as E, faults, incidents as I, mix, readings as R, report, requests as Q
from dipwatch.operators import search, series as S, slices
from dipwatch.operators.rollup import closed_only, decline_rollup, keep_since, merge_rollups, minute_rollup, new_only
from dipwatch.operators.streaks import pending_spans, promoted, streaks
from dipwatch.plans import detect as D
from dipwatch.plans import diagnose as G
from dipwatch.session import prepare, stage, stage_path
from dipwatch.sources import raw, tables
from dipwatch.sources.payments import WRITE_ORDER, as_payments, payments, raw_payments, with_transaction_id
from dipwatch.streaming import incident_stream, ingest, persistence

PLACES = 8


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, PLACES) for n in names})


def ts(text: str):
    return F.lit(text).cast("timestamp")


class Data:
    """Tables of one run. Nothing is kept between queries."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder
        self.merchants = C.merchants(spark)
        self.coverage = C.coverage(spark)
        self.catalog = C.decline_codes(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def payments(self) -> DataFrame:
        return payments(self.spark, self.folder)

    def rollup(self) -> DataFrame:
        return tables.rollup_table(self.spark, self.folder)

    def declines(self) -> DataFrame:
        return tables.decline_table(self.spark, self.folder)

    def both(self) -> tuple[DataFrame, DataFrame]:
        return tables.both_tables(self.spark, self.folder)

    def hypotheses(self) -> DataFrame:
        return R.hypotheses(self.rollup(), self.merchants, self.coverage)

    def readings(self, rollup: DataFrame | None = None) -> DataFrame:
        return D.all_readings(rollup if rollup is not None else self.rollup(), self.merchants, self.coverage)

    def confirmed(self, rollup: DataFrame) -> DataFrame:
        return promoted(streaks(R.confident(self.readings(rollup))))

    def signals(self, rollup: DataFrame, merchants: DataFrame | None = None) -> DataFrame:
        found = D.detect(rollup, merchants if merchants is not None else self.merchants, self.coverage)
        return found.signals

    def requests(self, rollup: DataFrame) -> DataFrame:
        """One request per confirmed drop, on the cell the detector named."""
        return stage(self.confirmed(rollup).select(
            F.concat_ws("@", F.col("minute").cast("string"), "cell_key").alias("request_id"), "bucket", "minute", *DIMS,
            "cell_key", "expected", "delta_pp", "split",
        ), "requests")

    def problems(self, rollup: DataFrame) -> DataFrame:
        """Every root in every minute, against its merchant's rate."""
        roots = rollup.select("bucket", "minute", *ROOT_DIMS).distinct().join(self.merchants, "merchant_id", "inner")
        return roots.select(
            F.concat_ws("@", F.col("minute").cast("string"), "merchant_id", "country").alias("pid"), "bucket", "minute",
            F.col("expected_conversion").alias("root_expected"), "delta_pp", *ROOT_DIMS,
            *[F.lit(None).cast("string").alias(d) for d in FREE_DIMS],
        )

    def diagnosis(self) -> tuple[DataFrame, D.Detection, DataFrame]:
        rollup, declines = self.both()
        found = D.detect(rollup, self.merchants, self.coverage)
        signals = stage(found.signals, "signals")
        return G.diagnose(signals, rollup, declines, self.merchants, self.coverage, self.catalog), found, rollup

    def episodes(self, rollup: DataFrame, readings: DataFrame | None = None) -> DataFrame:
        """Runs of drop readings per slice, as an incident table.

        A run ends when the next drop comes more than three minutes later.
        """
        drops = R.confident(readings if readings is not None else self.readings(rollup)).where(F.col("state") == DROP)
        runs = drops.groupBy("cell_key", *DIMS, F.session_window("bucket", "210 seconds").alias("w")).agg(
            F.min("bucket").alias("started_at"), F.max("bucket").alias("detected_at"), F.count(F.lit(1)).alias("windows"),
            F.sum(F.col("attempts") - F.col("approved")).alias("cost_usd_minor"),
        ).drop("w")
        last = rollup.agg(F.max("bucket").alias("last")).scalar()
        over = F.col("detected_at") + F.expr("INTERVAL 3 MINUTES")
        done = over <= last
        return runs.withColumns({
            "incident_id": F.concat_ws("@", "cell_key", F.date_format("started_at", "HH:mm")),
            "fingerprint": F.col("cell_key"),
            "status": F.when(done, "resolved").when(F.col("windows") > 1, "monitoring").otherwise("open"),
            "resolved_at": F.when(done, over),
            "cost_usd_per_min": F.floor(F.col("cost_usd_minor") * 100 / F.col("windows")).cast("bigint"),
            "dominant_decline": F.lit(None).cast("string"),
            "confidence": F.when(F.col("windows") >= 3, "CONFIRMED").otherwise("INCONCLUSIVE"),
        })

    def steps(self) -> DataFrame:
        """Conversation turns read as investigation steps of one run per conversation."""
        tool = F.element_at(F.array(*map(F.lit, (*audit.REQUIRED_TOOLS, "query_conversion_slice"))), (F.col("turn") % 4 + 1).cast("int"))
        size = F.length("text")
        status = F.when(size % 11 == 0, "running").when(size % 7 == 0, "failed").otherwise("completed")
        return self.table("conversations").select(
            F.col("conv_id").alias("run_id"), (F.col("turn") + 1).alias("step_no"), tool.alias("tool_name"),
            status.alias("status"), F.when(size % 5 != 0, F.col("role")).alias("tool_result"),
            F.when(size % 14 == 0, "TIMEOUT").alias("error_code"),
            F.array(F.col("turn"), F.col("turn") + 1).alias("evidence_step_nos"),
        )

    def runs(self) -> DataFrame:
        per = self.table("conversations").groupBy(F.col("conv_id").alias("run_id")).agg(
            F.max("turn").alias("last"), F.max(F.length("text")).alias("size")
        )
        return per.select(
            "run_id", F.expr("run_id div 10").alias("incident_id"), (F.col("size") * 60).alias("started_at"),
            F.when(F.col("size") % 3 == 0, "running").otherwise("completed").alias("status"),
            F.when(F.col("size") % 2 == 0, "CONCLUSIVE").otherwise("INCONCLUSIVE").alias("conclusion"),
            F.array(F.lit(1).cast("bigint"), F.col("last") + 2).alias("supporting_step_nos"),
        )


QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, folder: fn(Data(spark, folder))
    return fn


# --- ingest ---------------------------------------------------------------

@query
def q01_minute_rollup(d):
    return minute_rollup(d.payments())


@query
def q02_decline_rollup(d):
    return decline_rollup(d.payments())


@query
def q03_rollup_merge(d):
    tx = d.payments()
    noon = ts("2026-08-30 12:15:00")
    early, late = tx.where((F.col("created_at") < noon) | (F.col("status") == "SUCCESS")), tx.where(
        (F.col("created_at") >= noon) & (F.col("status") != "SUCCESS"))
    return merge_rollups(minute_rollup(early), minute_rollup(late))


def damaged_payloads(tx: DataFrame) -> DataFrame:
    """Wire payloads with known damage, placed by transaction id."""
    p, t = F.col("payload"), F.col("transaction_id")
    out = raw.payloads(tx)
    edits = [
        (t % 107 == 2, F.regexp_replace(p, '"amountMinor":', '"amountMinor":-')),
        (t % 109 == 3, F.regexp_replace(p, '"status":"SUCCESS"', '"status":"DECLINED"')),
        (t % 113 == 4, F.regexp_replace(p, '"paymentMethod":"CARD"', '"paymentMethod":"PIX"')),
        (t % 127 == 5, F.regexp_replace(p, '"merchantId":"[^"]*"', '"merchantId":7')),
        (t % 103 == 1, F.expr("substring(payload, 1, length(payload) - 2)")),
        (t % 101 == 0, F.lit(None).cast("string")),
    ]
    for when, new in edits:
        out = out.withColumn("payload", F.when(when, new).otherwise(p))
    return out.select("id", "payload")


@query
def q04_quarantine_counts(d):
    rows = raw.parsed(damaged_payloads(d.payments()))
    structural = F.col("reject_reason").isin("missing_payload", "bad_json")
    rules = F.when(structural | F.col("reject_reason").isNull(), "").otherwise(F.concat_ws(",", "broken_rules"))
    return rows.groupBy(F.coalesce("reject_reason", F.lit("clean")).alias("outcome"), rules.alias("rules")).agg(
        F.count(F.lit(1)).alias("entries")
    )


@query
def q05_retention_keep(d):
    tx = d.payments()
    now = raw_payments(d.spark, d.folder).agg((F.max("created_at") + F.expr("INTERVAL 65 SECONDS")).alias("t")).scalar()
    kept = minute_rollup(keep_since(tx, now, 15)).groupBy("bucket").agg(F.sum("attempts").alias("attempts"))
    return closed_only(kept, now)


@query
def q06_provider_series(d):
    r = d.rollup()
    since = r.agg((F.max("bucket") - F.expr("INTERVAL 20 MINUTES")).alias("t")).scalar()
    return S.provider_series(r, since)


@query
def q07_portfolio_series(d):
    r = d.rollup()
    since = r.agg((F.max("bucket") - F.expr("INTERVAL 20 MINUTES")).alias("t")).scalar()
    return S.portfolio_series(r, since)


@query
def q08_conversion_series(d):
    out = slices.conversion_series(
        d.rollup(), {"merchant_id": "BR_STORE_01", "payment_method": "CARD", "provider_id": "stripe"},
        ts("2026-08-30 12:05:00"), ts("2026-08-30 12:25:00"),
    )
    return rounded(out, "rate")


@query
def q09_rate_carried_forward(d):
    series = stage(d.rollup().groupBy("bucket", "provider_id").agg(F.sum("attempts").alias("attempts"), F.sum("approved").alias("approved")), "series")
    last = S.latest_rates(series).select("provider_id", F.col("rate").alias("latest_rate"))
    return rounded(S.carried_rates(series, RECENT_BUCKETS).join(last, "provider_id", "left"), "rate", "latest_rate")


# --- detection ------------------------------------------------------------

def _lens(d, column):
    tested = d.hypotheses().where(F.col(column).isNotNull()).withColumn("expected", F.col(column))
    out = with_verdict(tested, "approved", "attempts", "expected", "delta_pp")
    return rounded(out.select("bucket", cell_key().alias("cell_key"), "attempts", "approved", "expected", "ci_low", "ci_high", "state"),
                   "expected", "ci_low", "ci_high")


@query
def q10_absolute_lens(d):
    return _lens(d, "expected_absolute")


@query
def q11_cross_lens(d):
    return _lens(d, "expected_cross")


@query
def q12_temporal_lens(d):
    return _lens(d, "expected_temporal")


@query
def q13_family_z(d):
    return d_round(R.families(d.hypotheses()), 6, "z")


def d_round(df, places, *names):
    return df.withColumns({n: F.round(n, places) for n in names})


@query
def q14_readings(d):
    out = d.readings().select("bucket", "cell_key", "expected_source", "expected", "kind", "state", "attempts", "approved",
                              "ci_low", "ci_high", "window_used")
    return d_round(out, 6, "expected", "ci_low", "ci_high")


@query
def q15_thin_retry(d):
    thin = d.hypotheses().where("attempts < 30").withColumn(
        "expected", F.coalesce("expected_absolute", "expected_cross", "expected_temporal")
    )
    wide = with_verdict(thin, "wide_k", "wide_n", "expected", "delta_pp")
    return rounded(wide.select("bucket", cell_key().alias("cell_key"), "attempts", "wide_n", "wide_k", "expected", "state"), "expected")


@query
def q16_gaps(d):
    return R.gaps(d.readings()).select("bucket", "cell_key", "attempts", "reason")


def _flat_signals(signals):
    return d_round(signals.select(
        "bucket", "cell_key", "observed_rate", "expected_rate", "expected_source", "ci_low", "ci_high", "attempts",
        "approved", "window_used", "consecutive_windows", "first_bucket",
    ), 6, "observed_rate", "expected_rate", "ci_low", "ci_high")


@query
def q17_signals(d):
    return _flat_signals(d.signals(d.rollup()))


@query
def q18_pending(d):
    return pending_spans(streaks(R.confident(d.readings()))).select(
        "bucket", "cell_key", "attempts", "approved", "first_bucket", F.col("streak").alias("windows_confirmed"),
        "windows_required", "until_bucket",
    )


@query
def q19_onset(d):
    return d.signals(d.rollup()).select("bucket", "cell_key", "started_at", "started_at_exact")


@query
def q20_onset_query(d):
    r = d.rollup()
    found = Q.incident_onset(r, d.requests(r), calendar(r))
    return found.select("request_id", "started_at", "started_at_exact", F.size("evidence_minutes").alias("minutes"),
                        bucket_of(F.array_max("evidence_minutes")).alias("last_bucket"))


# --- search ---------------------------------------------------------------

@query
def q21_residual(d):
    """Each root without its worst provider."""
    r = d.rollup()
    problems = d.problems(r)
    by_provider = r.groupBy("bucket", "minute", *ROOT_DIMS, "provider_id").agg(
        F.sum("attempts").alias("n"), F.sum("approved").alias("k")
    )
    worst = by_provider.groupBy("minute", *ROOT_DIMS).agg(
        F.min_by("provider_id", F.struct(rate(F.col("k"), F.col("n")), "provider_id")).alias("p")
    )
    carved = worst.select(
        F.concat_ws("@", F.col("minute").cast("string"), "merchant_id", "country").alias("pid"),
        F.col("merchant_id").alias("cell_merchant_id"), F.col("p").alias("cell_provider_id"), F.col("country").alias("cell_country"),
        F.lit(None).cast("string").alias("cell_payment_method"), F.lit(None).cast("string").alias("cell_issuer_id"),
    )
    out = search.residual(r, problems, carved)
    return rounded(out.select("pid", "attempts", "approved", "rate", "deficit", "ci_low", "ci_high", "state"),
                   "rate", "deficit", "ci_low", "ci_high")


@query
def q22_lattice(d):
    return slices.lattice_sums(d.rollup()).select("bucket", cell_key().alias("cell_key"), "attempts", "approved", "amount_usd_sum")


def _candidates(d):
    r = d.rollup()
    return search.candidates(r, stage(d.problems(r), "problems"), d.coverage)


@query
def q23_beam_depth1(d):
    level = _candidates(d).where("depth = 1").select("pid", F.col("key").alias("cell_key"), "n", "k", "expected", "explained",
                                                      "beam", "admissible")
    return rounded(level, "expected", "explained")


@query
def q24_first_peel(d):
    first = _candidates(d).where("causal").select("pid", F.col("key").alias("cell_key"), "n", "k", "expected", "explained",
                                                  "concentration")
    return rounded(first, "expected", "explained", "concentration")


def _peels(d):
    r = d.rollup()
    return search.peel(r, stage(d.problems(r), "problems"), d.coverage)


@query
def q25_peels(d):
    causes, _ = _peels(d)
    return rounded(causes.select("pid", "peel_no", F.col("key").alias("cell_key"), "attempts", "approved", "expected",
                                 "explained", "ci_low", "ci_high"), "expected", "explained", "ci_low", "ci_high")


@query
def q26_echoes(d):
    _, echoes = _peels(d)
    return rounded(echoes.select("pid", "peel_no", F.col("key").alias("cell_key"), "observed", "residual_rate"),
                   "observed", "residual_rate")


@query
def q27_diagnoses(d):
    found, _, _ = d.diagnosis()
    return rounded(found.select(
        "request_id", "bucket", cell_key().alias("cell_key"), "confidence", "origin", "causal_dimension", "attempts", "approved",
        "observed_rate", "expected_rate", "explained_deficit", "started_at", "started_at_exact", "lost_approvals",
        "cost_usd_minor", "priority_score", "dominant_code", "attribution", F.size("echoes").alias("echo_count"),
    ), "observed_rate", "expected_rate", "explained_deficit", "priority_score").orderBy(F.desc("priority_score"), "request_id")


# --- mix and impact -------------------------------------------------------

def _shifts(d):
    r, dec = d.both()
    asked = d.requests(r)
    return asked, dec, mix.decline_shifts(dec, asked, d.catalog)


@query
def q28_decline_mix(d):
    _, _, shifts = _shifts(d)
    return rounded(shifts.select("request_id", "window_min", "total_declines", "reference_source", "code", "family", "count",
                                 "observed_share", "reference_share", "moved_pp"), "observed_share", "reference_share", "moved_pp")


@query
def q29_dominant_code(d):
    _, _, shifts = _shifts(d)
    return mix.dominant(shifts)


@query
def q30_outage_attribution(d):
    asked, dec, shifts = _shifts(d)
    return mix.outage_attribution(dec, mix.outage_scopes(asked, mix.dominant(shifts)))


@query
def q31_impact(d):
    r = d.rollup()
    found = d.signals(r).withColumn("request_id", F.concat_ws("@", F.col("minute").cast("string"), "cell_key"))
    asked = found.select("request_id", "bucket", "minute", *DIMS, "started_minute", F.col("expected_rate").alias("expected"))
    out = Q.incident_impact(r, stage(asked, "asked"))
    return rounded(out.select("request_id", "duration_min", "lost_approvals", "avg_ticket_usd_minor", "cost_usd_minor",
                              "currency", "cost_local_minor", "cost_usd_per_min", "priority_score"), "priority_score")


# --- evidence and incidents -----------------------------------------------

@query
def q32_evidence(d):
    found, _, _ = d.diagnosis()
    return E.evidence_json(E.evidence(found))


def _incidents(d):
    found, detection, rollup = d.diagnosis()
    ev = stage(E.evidence(found), "evidence")
    span = rollup.agg(F.min("minute"), F.max("minute")).first()
    log = stage(I.incident_log(ev, detection.gaps, *span), "log")
    return ev, log


@query
def q33_incidents(d):
    ev, log = _incidents(d)
    return I.with_playbook(I.incidents(log, ev), C.playbooks(d.spark)).select(
        "incident_id", "status", "cell_key", "fingerprint", "opened_at", "detected_at", "resolved_at", "started_at",
        "lost_approvals", "cost_usd_minor", "cost_usd_per_min", "playbook_id",
    )


@query
def q34_transitions(d):
    _, log = _incidents(d)
    return I.transitions(log)


@query
def q35_incident_extent(d):
    r = d.rollup()
    confirmed = d.confirmed(r)
    return confirmed.groupBy("cell_key", F.session_window("bucket", "210 seconds").alias("w")).agg(
        F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"), F.count(F.lit(1)).alias("windows")
    ).drop("w")


@query
def q36_recall(d):
    return I.recall(stage(d.episodes(d.rollup()), "episodes")).select("incident_id", "place", "similar_id", "summary")


@query
def q37_playbook(d):
    asked, _, shifts = _shifts(d)
    lead = mix.dominant(shifts).select("request_id", "dominant_family")
    shape = (
        F.when(F.col("issuer_id").isNotNull(), "issuer").when(F.col("provider_id").isNotNull(), "provider")
        .when(F.col("payment_method").isNotNull(), "method").otherwise("merchant")
    )
    rows = asked.join(lead, "request_id", "left").withColumn("causal_dimension", shape)
    return I.with_playbook(rows, C.playbooks(d.spark)).select("request_id", "causal_dimension", "dominant_family", "playbook_id", "owner")


@query
def q38_feed(d):
    return report.with_badges(I.newest(d.episodes(d.rollup()), 100)).select(
        "incident_id", "status", "tier", "badge", "cause_label", "cost_usd_per_min", "detected_at"
    ).orderBy(F.desc("cost_usd_per_min"), "incident_id")


@query
def q39_history(d):
    labelled = report.with_names(d.episodes(d.rollup())).withColumn("label", report.dimension_label())
    return report.history(labelled, status="resolved", text="Itau").select("incident_id", "label", "status", "detected_at")


@query
def q40_report(d):
    named = report.with_names(d.episodes(d.rollup()))
    cost = F.col("cost_usd_minor") * 1000
    return named.select(
        "incident_id", report.dimension_label().alias("label"),
        F.concat(report.dimension_label(), F.lit(" is degrading")).alias("headline"),
        report.money(F.floor(cost / 10000) * 10000).alias("cost_text"),
        report.minutes_since(F.col("started_at"), F.col("windows") > 1, ts("2026-08-30 12:30:00")).alias("since_text"),
    )


@query
def q41_conversion_slice(d):
    r = d.rollup()
    cells = slices.lattice_sums(r).select("bucket", "minute", *DIMS)
    asked = stage(cells.withColumn("request_id", F.concat_ws("@", F.col("minute").cast("string"), cell_key())), "asked")
    out = Q.conversion_slice(r, asked, d.merchants)
    return rounded(out.select("request_id", "split_dim", "attempts", "approved", "conversion_rate", "expected",
                              "expected_source", "ci_low", "ci_high", "state"), "conversion_rate", "expected", "ci_low", "ci_high")


# --- faults, grid, rates --------------------------------------------------

FAULTS = [
    ("acquirer", 1, "2026-08-30 12:12:00", "2026-08-30 12:21:00", "BR_STORE_01", "stripe", None, None, "itau", 0.15, 900, 0.75),
    ("bank", 2, "2026-08-30 12:15:00", "2026-08-30 12:25:00", "MX_STORE_02", None, None, None, "bbva_mx", 0.3, None, None),
    ("rail", 3, "2026-08-30 12:18:00", None, None, None, "BR", None, None, 0.9, 50, 0.5),
]
FAULT_COLUMNS = ("fault_id", "place", "starts_at", "ends_at", "merchant_id", "provider_id", "country", "payment_method",
                 "issuer_id", "conversion_multiplier", "latency_ms_increase", "weight_05")


@query
def q42_fault_labels(d):
    known = d.spark.sql(C.values_sql(FAULTS, FAULT_COLUMNS)).withColumns({
        "starts_at": F.col("starts_at").cast("timestamp"), "ends_at": F.col("ends_at").cast("timestamp"),
        "latency_ms_increase": F.col("latency_ms_increase").cast("bigint"),
        "decline_weights": F.when(F.col("weight_05").isNotNull(), F.create_map(F.lit("05"), F.col("weight_05").cast("double"))),
    })
    labelled = faults.label_faults(d.payments(), known)
    out = labelled.groupBy(
        F.date_trunc("minute", "created_at").alias("bucket"), F.concat_ws(",", "fault_ids").alias("faults"),
        F.round("conversion_multiplier", 6).alias("multiplier"), F.col("latency_ms_increase").alias("latency"),
        F.coalesce(F.try_element_at("decline_weights", F.lit("05")), F.lit(-1.0)).alias("weight_05"),
    ).agg(F.count(F.lit(1)).alias("payments"))
    return out


@query
def q43_silent_cells(d):
    grid = faults.cell_grid(C.merchant_countries(d.spark), d.coverage, C.issuer_countries(d.spark))
    seen = d.rollup()
    silent = faults.silent_cells(grid, seen).select(cell_key().alias("cell_key"), F.lit("silent").alias("kind"))
    extra = faults.undeclared_cells(grid.where("provider_id <> 'adyen'"), seen).select(cell_key().alias("cell_key"), F.lit("undeclared").alias("kind"))
    return silent.unionByName(extra)


@query
def q44_fx_dated(d):
    orders = d.table("orders").select(
        F.element_at(F.array(*map(F.lit, ("ARS", "MXN", "BRL"))), (F.col("o_custkey") % 3 + 1).cast("int")).alias("currency"),
        F.col("o_orderdate").alias("created_at"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount_minor"),
    )
    days = orders.where(F.col("currency") != "ARS").select("currency", F.to_date("created_at").alias("rate_date")).distinct()
    rates = days.withColumn("usd_per_1000", F.when(F.col("currency") == "MXN", 55).otherwise(180) + F.dayofmonth("rate_date"))
    usd = F.expr("amount_minor * usd_per_1000 div 1000")
    return tables.dated_rates(orders, rates).groupBy("currency", F.date_format("rate_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), F.count("usd_per_1000").alias("rated"), F.sum(usd).alias("usd_minor"),
    )


# --- audits ---------------------------------------------------------------

@query
def q45_number_grounding(d):
    """Numbers in each document that the evidence object kept beside it does not hold."""
    docs = d.table("documents")
    kept = docs.select(F.col("doc_id").alias("id"), F.to_json(F.struct(
        "n_chars", "source", (F.col("doc_id") % 100 / 100).alias("rate"), F.array(F.col("doc_id") % 10).alias("sizes"),
    )).alias("evidence"))
    return audit.ungrounded_numbers(docs.select(F.col("doc_id").alias("id"), "text"), audit.allowed_from_json(kept))


@query
def q46_audit_refs(d):
    steps, runs = d.steps(), d.runs()
    text = lambda c: F.col(c).cast("string")
    refs = audit.bad_references(steps).select("run_id", F.concat_ws(":", text("step_no"), text("ref")).alias("detail"), "reason")
    weak = audit.unsupported_conclusions(runs, steps).select("run_id", "detail", "reason")
    open_runs = audit.orphan_runs(runs).select("run_id", F.lit("").alias("detail"), F.lit("orphan").alias("reason"))
    odd = audit.inconsistent_steps(steps).select("run_id", text("step_no").alias("detail"), "reason")
    return refs.unionByName(weak).unionByName(open_runs).unionByName(odd)


# --- streaming ------------------------------------------------------------

def _ingested(d) -> DataFrame:
    base = stage_path(d.spark, "ingest")
    store = ingest.Store(d.spark, f"{base}/store")
    lines = with_transaction_id(ingest.line_stream(d.spark, d.folder))
    ingest.run_available(lines, f"{base}/checkpoint", ingest.ingest_batch(store, list(WRITE_ORDER), as_payments))
    return ingest.stored_rollup(store, minute_rollup(d.payments()).schema)


@query
def q47_stream_rollup(d):
    return _ingested(d)


@query
def q47b_stream_closed_windows(d):
    base = stage_path(d.spark, "windows")
    store = ingest.Store(d.spark, f"{base}/store")
    lines = with_transaction_id(ingest.line_stream(d.spark, d.folder))
    ingest.run_available(lines, f"{base}/ingest", ingest.ingest_batch(store, list(WRITE_ORDER), as_payments))
    # A second stream over the stored facts, which hold each transaction once.
    facts = d.spark.readStream.schema(d.payments().schema).parquet(f"{base}/store/facts")
    windows = ingest.closed_windows(facts, ["provider_id"])
    run = windows.writeStream.format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/checkpoint"
    ).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return d.spark.read.schema(windows.schema).parquet(f"{base}/out")


@query
def q47c_stream_dedup(d):
    base = stage_path(d.spark, "dedup")

    def each(batch, batch_id):
        batch.groupBy(F.date_trunc("minute", "created_at").alias("bucket"), "provider_id").agg(
            F.count(F.lit(1)).alias("attempts")
        ).write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    ingest.run_available(ingest.deduplicated(ingest.payment_stream(d.spark, d.folder)), f"{base}/checkpoint", each)
    schema = "bucket timestamp, provider_id string, attempts bigint"
    return d.spark.read.schema(schema).parquet(f"{base}/out").groupBy("bucket", "provider_id").agg(F.sum("attempts").alias("attempts"))


@query
def q48_stream_signals(d):
    readings = R.confident(d.readings()).select("cell_key", "minute", "state")
    base = stage_path(d.spark, "streaks")
    readings.write.parquet(f"{base}/readings")
    stream = persistence.streaming_streaks(d.spark.readStream.schema(readings.schema).parquet(f"{base}/readings"))
    ingest.run_available(stream, f"{base}/checkpoint", lambda b, i: b.write.mode("overwrite").parquet(f"{base}/out/batch_id={i}"))
    out = d.spark.read.schema(persistence.STREAK_SCHEMA).parquet(f"{base}/out")
    return promoted(out).select(bucket_of("minute").alias("bucket"), "cell_key", F.col("streak").alias("consecutive_windows"),
                                bucket_of("first_minute").alias("first_bucket"))


# --- markers, drill-down, slice queries -----------------------------------

@query
def q49_marker_bucket(d):
    start = F.minute("ts") * 60 + F.second("ts")
    markers = d.table("events").select(
        F.col("event_id").alias("marker_id"), (F.lit(29801520) + F.ceil(start / 60)).cast("bigint").alias("starts_minute")
    )
    r = d.rollup()
    last = r.agg(F.max("minute").alias("m")).scalar()
    return S.marker_buckets(markers, calendar(r), last).select("marker_id", bucket_of("minute").alias("bucket"))


@query
def q50_drilldown_map(d):
    r = d.rollup()
    axes = F.explode(F.array(*map(F.lit, FREE_DIMS))).alias("axis")
    parents = d.problems(r).select("pid", "bucket", *DIMS, axes).withColumn("step_id", F.concat_ws("/", "pid", "axis"))
    maps = E.sibling_rates(r, parents.drop("pid"))
    return rounded(maps.select("step_id", F.explode("rates").alias("value", "rate")), "rate")


@query
def q51_residual_verdict(d):
    r = d.rollup()
    roots = d.problems(r).select("bucket", "minute", *DIMS)
    axis = F.explode(F.array(F.struct(F.lit("provider_id").alias("dim"), F.lit("stripe").alias("value")),
                             F.struct(F.lit("issuer_id").alias("dim"), F.lit("bbva_mx").alias("value")))).alias("c")
    asked = roots.select("*", axis).select(
        F.concat_ws("@", F.col("minute").cast("string"), "merchant_id", "country", "c.dim").alias("request_id"), "bucket", "minute",
        *DIMS, F.col("c.dim").alias("candidate_dim"), F.col("c.value").alias("candidate_value"),
    )
    return rounded(Q.residual_test(r, stage(asked, "asked"), d.merchants, d.coverage), "explained_deficit", "residual_delta_pp")


@query
def q52_history_slice(d):
    r = d.rollup()
    asked = d.requests(r).withColumns({"from_minute": F.col("minute") - 10, "to_minute": F.col("minute") + 1})
    return rounded(Q.conversion_history(r, asked, calendar(r)), "conversion_rate")


@query
def q53_mix_slice(d):
    r, dec = d.both()
    cells = slices.slice_sums(r).select("bucket", "minute", *DIMS)
    asked = stage(cells.withColumn("request_id", F.concat_ws("@", F.col("minute").cast("string"), cell_key())), "asked")
    totals = mix.window_totals(dec, asked)
    top = mix.shift_arrays(mix.decline_shifts(dec, asked, d.catalog)).select(
        "request_id", F.size("shifts").alias("codes"), F.element_at("shifts", 1)["code"].alias("most_moved")
    )
    return totals.join(top, "request_id", "left")


@query
def q54_onset_slice(d):
    r = d.rollup()
    cells = slices.slice_sums(r).select(
        F.concat_ws("@", F.col("minute").cast("string"), cell_key()).alias("request_id"), "minute", *DIMS,
        F.lit(0.9).alias("expected"), F.lit(3.0).alias("delta_pp"),
    )
    found = Q.incident_onset(r, stage(cells, "asked"), calendar(r))
    return found.select("request_id", "started_at", "started_at_exact", F.size("evidence_minutes").alias("minutes"))


@query
def q55_impact_slice(d):
    r = d.rollup()
    cells = slices.slice_sums(r).select(
        F.concat_ws("@", F.col("minute").cast("string"), cell_key()).alias("request_id"), "minute", *DIMS,
        (F.col("minute") - 9).alias("started_minute"), F.lit(0.95).alias("expected"),
    )
    out = Q.incident_impact(r, stage(cells, "asked"))
    return rounded(out.select("request_id", "duration_min", "lost_approvals", "avg_ticket_usd_minor", "cost_usd_minor",
                              "cost_local_minor", "cost_usd_per_min", "priority_score"), "priority_score")


@query
def q56_slice_validity(d):
    lines = d.table("lineitem")
    pick = lambda expr, names: F.element_at(F.array(*[F.lit(n) for n in names]), F.expr(f"cast({expr} as int) + 1"))
    asked = lines.select(
        pick("l_partkey % 5", ("BR_STORE_01", "MX_STORE_01", "AR_STORE_01", None, "")).alias("merchant_id"),
        pick("l_linenumber % 3", ("stripe", "adyen", None)).alias("provider_id"),
        pick("l_suppkey % 5", ("BR", "MX", "AR", None, "US")).alias("country"),
        pick("l_orderkey % 4", ("CARD", "PIX", None, "CASH")).alias("payment_method"),
        pick("(l_partkey div 5) % 3", ("NA", "itau", None)).alias("issuer_id"),
    )
    return asked.groupBy(F.coalesce(Q.invalid_reason(), F.lit("valid")).alias("verdict")).agg(F.count(F.lit(1)).alias("slices"))


@query
def q57_bucket_plan(d):
    """Per merchant, the minutes to process after the last one with an outage code, or all if there is none."""
    r, dec = d.both()
    target, oldest = r.agg(F.max("bucket").alias("t")).scalar(), r.agg(F.min("bucket").alias("t")).scalar()
    cursors = r.select("merchant_id").distinct().join(
        dec.where("decline_code in ('91', 'DS0G')").groupBy("merchant_id").agg(F.max("bucket").alias("cursor")), "merchant_id", "left"
    )
    plan = ingest.bucket_plan(F.col("cursor"), oldest, target)
    return cursors.select("merchant_id", F.explode(plan).alias("bucket"))


@query
def q58_new_only_append(d):
    raw_tx = raw_payments(d.spark, d.folder)
    stored = raw_tx.where(F.col("created_at") < ts("2026-08-30 12:20:00"))
    late = d.payments().where(F.col("created_at") >= ts("2026-08-30 12:10:00"))
    return minute_rollup(new_only(late, stored, ["transaction_id"])).groupBy("bucket").agg(F.sum("attempts").alias("attempts"))


@query
def q59_config_update(d):
    return _flat_signals(d.signals(d.rollup(), tables.set_expected_conversion(d.merchants, 0.95)))


# --- lists and joins ------------------------------------------------------

@query
def q60_latest_evidence(d):
    arrived = d.readings().select(
        F.concat_ws("|", "merchant_id", "country").alias("fingerprint"), "bucket",
        F.concat_ws("/", F.col("minute").cast("string"), "cell_key").alias("arrival"), "state",
    )
    return I.latest_evidence(arrived)


@query
def q61_run_steps(d):
    place = Window.partitionBy("incident_id").orderBy(F.desc("started_at"), "run_id")
    runs = d.runs().withColumn("place", F.row_number().over(place)).select("incident_id", "run_id", "place")
    return runs.join(d.steps().select("run_id", "step_no", "tool_name", "status"), "run_id", "inner")


@query
def q62_live_candidates(d):
    """For each confirmed drop the run it belongs to at that time: narrowest, then newest."""
    r = d.rollup()
    read = d.readings(r)
    runs = d.episodes(r, read).select(
        "incident_id", "started_at", "detected_at", *[F.col(x).alias(f"live_{x}") for x in DIMS], specificity().alias("fixed")
    )
    signals = promoted(streaks(R.confident(read))).select("bucket", "cell_key", *DIMS)
    # Both sides carry days, so a root's drops meet only the runs of their day.
    minute = lambda c: F.expr(f"unix_seconds({c}) div 60")
    runs = runs.withColumn("block", F.explode(blocks_between(minute("started_at"), minute("detected_at") + 3)))
    signals = signals.withColumn("day_block", block_of(minute("bucket")))
    on = [F.col("day_block") == F.col("block"), *[signals[x] == runs[f"live_{x}"] for x in ROOT_DIMS]]
    on += [F.col("started_at") < F.col("bucket"), F.col("bucket") <= F.col("detected_at") + F.expr("INTERVAL 3 MINUTES")]
    joined = signals.join(runs, [*on, compatible("", "live_", FREE_DIMS)], "inner")
    best = F.max_by("incident_id", F.struct("fixed", "detected_at", "incident_id"))
    return joined.groupBy("bucket", "cell_key").agg(best.alias("incident_id"), F.count(F.lit(1)).alias("fitting"))


def _signals_and_candidates(d):
    r = d.rollup()
    cands = search.candidates(r, stage(d.problems(r), "problems"), d.coverage)
    return stage(d.confirmed(r), "confirmed"), cands


@query
def q63_signal_root_join(d):
    """Causal cells with the first signal of their root and minute."""
    signals, cands = _signals_and_candidates(d)
    first = G.with_order(signals).groupBy("bucket", *ROOT_DIMS).agg(F.min_by("cell_key", "place").alias("signal_key"))
    return cands.where("causal").select("bucket", *ROOT_DIMS, F.col("key").alias("cause_key")).join(
        first, ["bucket", *ROOT_DIMS], "inner"
    )


@query
def q64_exact_cell_join(d):
    """Signals matched to search candidates of exactly the same cell."""
    signals, cands = _signals_and_candidates(d)
    right = cands.select(F.col("bucket").alias("b"), *[F.col(x).alias(f"c_{x}") for x in DIMS], "explained")
    left = signals.select("bucket", "cell_key", *DIMS)
    on = [F.col("bucket") == F.col("b"), same_cell("", "c_")]
    out = left.join(right, on, "left").select("bucket", "cell_key", F.col("b").isNotNull().alias("matched"), "explained")
    return rounded(out, "explained")


@query
def q65_mix_normalised(d):
    weights = d.catalog.withColumn("weight", F.col("baseline_share") / F.sum("baseline_share").over(Window.partitionBy("payment_method")))
    seen = d.declines().groupBy("payment_method", F.col("decline_code").alias("code")).agg(F.sum("declines").alias("declines"))
    seen = seen.withColumn("share", F.col("declines") / F.sum("declines").over(Window.partitionBy("payment_method")))
    return rounded(weights.select("payment_method", "code", "weight").join(seen, ["payment_method", "code"], "left"), "weight", "share")


@query
def q66_stream_snapshot(d):
    r = stage(_ingested(d), "streamed")
    since = r.agg((F.max("bucket") - F.expr("INTERVAL 20 MINUTES")).alias("t")).scalar()
    whole = S.portfolio_series(r, since).withColumn("provider_id", F.lit("all"))
    return S.provider_series(r, since).unionByName(whole)


@query
def q67_evidence_precedence(d):
    """Agent objects offered to the incidents: one per confirmed drop of the same root and minute."""
    ev, log = _incidents(d)
    signals = stage(d.confirmed(d.rollup()), "confirmed")
    live = log.where(F.col("action").isin("opened", "updated", "refreshed")).select("incident_id", "minute", *ROOT_DIMS).distinct()
    offered = signals.join(live, ["minute", *ROOT_DIMS], "inner").select(
        "incident_id", "minute", F.lit("agent").alias("source"), F.concat_ws("@", F.lit("agent"), "minute", "cell_key").alias("request_id"),
        *FREE_DIMS,
    )
    return I.stored_evidence(log, offered)


@query
def q68_trail(d):
    found, _, rollup = d.diagnosis()
    found = stage(found, "diagnoses")
    return E.trail(found, rollup).select("request_id", "step_no", "tool_name", "decision_tag", "axis", "fixed_value",
                                         F.size("rates").alias("siblings"), "decision_summary")


@query
def q69_narratives(d):
    found, _, _ = d.diagnosis()
    return report.report(E.evidence(found), C.playbooks(d.spark)).select("request_id", "headline", "narrative_ops", "narrative_exec")


# --- scans and lists of the monitor ---------------------------------------

@query
def q70_window_rows(d):
    """The rollup of the newest minute."""
    r = d.rollup()
    return tables.window_rows(r, r.agg(F.max("bucket").alias("b")).scalar()).drop("day", "minute")


@query
def q71_rollup_history(d):
    """Attempts by provider in the ten minutes before the newest one, which is left out."""
    r = d.rollup()
    end = r.agg(F.max("bucket").alias("b")).scalar()
    return tables.history(r, end - F.expr("INTERVAL 10 MINUTES"), end).groupBy("bucket", "provider_id").agg(F.sum("attempts").alias("attempts"))


@query
def q72_decline_history(d):
    """Declines by code in the ten minutes before the newest one."""
    dec = d.declines()
    end = dec.agg(F.max("bucket").alias("b")).scalar()
    return tables.history(dec, end - F.expr("INTERVAL 10 MINUTES"), end).groupBy("decline_code").agg(F.sum("declines").alias("declines"))


@query
def q73_closed_merchants(d):
    """Merchants that closed incidents have been seen at."""
    return I.closed(d.episodes(d.rollup())).select("merchant_id").distinct()


@query
def q74_conversion_without_country(d):
    """Slices of a merchant and a provider in every minute, whatever the country."""
    r = d.rollup()
    asked = r.select("bucket", "minute", "merchant_id", "provider_id").distinct().select(
        F.concat_ws("@", F.col("minute").cast("string"), "merchant_id", "provider_id").alias("request_id"), "bucket", "minute", "merchant_id",
        "provider_id", *[F.lit(None).cast("string").alias(x) for x in ("country", "payment_method", "issuer_id")],
    )
    return Q.conversion_slice(r, stage(asked, "asked"), d.merchants).select("request_id", "attempts", "approved")


@query
def q75_payload_ingest(d):
    """JSON files, each delivered twice and read in four batches, to facts and quarantine."""
    base = stage_path(d.spark, "payload-ingest")
    parts = int(d.spark.conf.get("spark.sql.shuffle.partitions"))
    lines = damaged_payloads(payments(d.spark, d.folder, parts)).select(F.coalesce("payload", F.lit("")).alias("value"))
    for _ in range(2):
        lines.write.mode("append").text(f"{base}/in")
    files = len(d.spark.read.text(f"{base}/in").inputFiles())
    store = ingest.Store(d.spark, f"{base}/store")
    known = {"merchant_id": d.merchants.select("merchant_id"), "issuer_id": C.issuer_countries(d.spark).select("issuer_id").unionAll(
        d.spark.range(1).select(F.lit("NA")))}
    each = ingest.payload_batch(store, known, ingest.ingest_batch(store, ingest.PAYMENT_ORDER))
    ingest.run_available(ingest.payload_stream(d.spark, f"{base}/in", per_trigger=max(1, -(-files // 4))), f"{base}/checkpoint", each)
    facts = d.spark.read.parquet(f"{base}/store/facts").select(F.lit("fact").alias("outcome"))
    aside = d.spark.read.parquet(f"{base}/store/quarantine").select(F.col("reject_reason").alias("outcome"))
    return facts.unionAll(aside).groupBy("outcome").agg(F.count(F.lit(1)).alias("entries"))


# --- incidents of every confirmed drop -------------------------------------

def _drops(d) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """Every confirmed drop as evidence on its own cell, the gaps, and the minutes that the clock runs over."""
    rollup = d.rollup()
    readings = stage(d.readings(rollup), "readings")
    confirmed = promoted(streaks(R.confident(readings)))
    shown = confirmed.select(
        "bucket", "minute", *DIMS, "cell_key", F.concat_ws("@", F.col("minute").cast("string"), "cell_key").alias("request_id"),
        (F.col("attempts") * F.col("expected") - F.col("approved")).alias("priority_score"),
    )
    thin = R.gaps(readings)
    first, last = rollup.agg(F.min("minute"), F.max("minute")).first()
    return stage(shown, "drops"), stage(thin, "gaps"), (first, last)


LOG_OUT = (*ROOT_DIMS, "minute", "incident_id", "action", "request_id", *FREE_DIMS)


@query
def q76_stream_incidents(d):
    """Incidents as a stream: files of ten minutes, each second one after its successor, within a watermark of half an hour."""
    shown, thin, (first, last) = _drops(d)
    base, delay = stage_path(d.spark, "incidents"), 30
    rows = incident_stream.stream_rows(shown, thin)
    part = F.floor((F.unix_seconds("bucket") / 60 - first) / 10)
    # The order of arrival is that of the folders: one write, one file a stretch of time.
    rows.withColumn("arrival", (part + F.when(part % 2 == 0, 2).otherwise(0) * 1.0).cast("long")).repartition("arrival").write.partitionBy(
        "arrival").parquet(f"{base}/rows")
    stretches = sorted(r.arrival for r in d.spark.read.parquet(f"{base}/rows").select("arrival").distinct().collect())
    schema = rows.schema
    for at in stretches:
        d.spark.read.schema(schema).parquet(f"{base}/rows/arrival={at}").write.mode("append").parquet(f"{base}/in")
    incident_stream.clock_row(d.spark, last + delay).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = d.spark.readStream.schema(incident_stream.ROWS).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    incident_stream.run_incidents(stream, base, f"{delay} minutes")
    return d.spark.read.schema(I.LOG_SCHEMA).parquet(f"{base}/log").select(*LOG_OUT)


@query
def q77_incident_log(d):
    """The same incidents by the batch fold over sessions."""
    shown, thin, span = _drops(d)
    return I.incident_log(shown, thin, *span).select(*LOG_OUT)
