"""Diagnosis of confirmed drops: causes, onset, decline mix and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipwatch.constants import DELTA_PP_DEFAULT, DIMS, FREE_DIMS, ONSET_LOOKBACK_MIN, ROOT_DIMS
from dipwatch.functions.cells import compatible, specificity
from dipwatch.functions.minutes import calendar
from dipwatch.operators.impact import IMPACT_SERIES, with_impact
from dipwatch.operators.mix import decline_shifts, dominant, outage_attribution, outage_scopes, shift_arrays, window_totals
from dipwatch.operators.onset import collect_lookback, with_onset
from dipwatch.operators.search import peel
from dipwatch.operators.slices import cell_series
from dipwatch.session import stage

SPLIT_ORDER = "CASE split WHEN 'root' THEN 0 WHEN 'provider' THEN 1 WHEN 'issuer' THEN 2 ELSE 3 END"


def with_order(signals: DataFrame) -> DataFrame:
    """Position of a signal among those of its minute and root."""
    return signals.withColumn("place", F.struct(F.expr(SPLIT_ORDER).alias("split"), F.col("cell_key").alias("key")))


def root_signals(signals: DataFrame) -> DataFrame:
    """One row per minute and root: longest streak, and the signal closest to the root."""
    taken = F.struct(
        "attempts", "approved", "observed_rate", "expected_rate", "expected_source", "ci_low", "ci_high", "window_used"
    )
    return with_order(signals).groupBy("bucket", "minute", *ROOT_DIMS).agg(
        F.max("consecutive_windows").alias("consecutive_windows"),
        F.min_by(taken, F.struct(specificity().alias("n"), "place")).alias("root_signal"),
    )


def _as_problems(rows: DataFrame) -> DataFrame:
    return rows.select("pid", "bucket", "minute", "root_expected", "delta_pp", *DIMS)


def root_problems(roots: DataFrame, merchants: DataFrame) -> DataFrame:
    """Roots of configured merchants, ready for the search."""
    return roots.join(merchants, "merchant_id", "inner").select(
        F.concat_ws("@", F.col("minute").cast("string"), "merchant_id", "country").alias("pid"),
        "bucket", "minute", *ROOT_DIMS, *[F.lit(None).cast("string").alias(d) for d in FREE_DIMS],
        F.col("expected_conversion").alias("root_expected"),
        F.coalesce("delta_pp", F.lit(DELTA_PP_DEFAULT)).alias("delta_pp"),
        "consecutive_windows", "root_signal",
    )


def unexplained(signals: DataFrame, causes: DataFrame) -> DataFrame:
    """Narrow signals of a diagnosed root that no cause of it is compatible with."""
    narrow = signals.where(specificity() > 2)
    found = causes.select("bucket", *ROOT_DIMS, *[F.col(d).alias(f"cause_{d}") for d in FREE_DIMS])
    rooted = narrow.join(found.select("bucket", *ROOT_DIMS).distinct(), ["bucket", *ROOT_DIMS], "left_semi")
    on = [rooted[c] == found[c] for c in ("bucket", *ROOT_DIMS)]
    return rooted.join(found, [*on, compatible("", "cause_", FREE_DIMS)], "left_anti")


def accept_rescues(asked: DataFrame, rescued: DataFrame) -> DataFrame:
    """Which rescued causes count, signals taken in order.

    A cause accepted for one signal silences later signals it is compatible
    with. The list per minute and root is bounded by the slices of a root, so
    the sequence is one array fold per root. Returns accepted (pid, peel_no).
    """
    cell = "struct<pid:string,peel_no:int,key:string,provider_id:string,payment_method:string,issuer_id:string>"
    causes = rescued.groupBy("pid").agg(
        F.array_sort(F.collect_list(F.struct("peel_no", "pid", "key", *FREE_DIMS))).alias("found")
    ).select(
        "pid",
        F.transform("found", lambda c: F.struct(c["pid"], c["peel_no"], c["key"], *[c[d] for d in FREE_DIMS]))
        .cast(f"array<{cell}>").alias("found"),
    )
    queue = with_order(asked).join(causes, "pid", "inner").groupBy("bucket", *ROOT_DIMS).agg(
        F.array_sort(F.collect_list(F.struct("place", *FREE_DIMS, "found"))).alias("queue")
    )

    def agrees(taken, signal):
        ok = F.lit(True)
        for d in FREE_DIMS:
            ok = ok & (taken[d].isNull() | signal[d].isNull() | (taken[d] == signal[d]))
        return ok

    def take(taken, signal):
        silent = F.exists(taken, lambda t: agrees(t, signal))
        fresh = F.filter(signal["found"], lambda c: ~F.exists(taken, lambda t: t["key"] == c["key"]))
        return F.when(silent, taken).otherwise(F.concat(taken, fresh))

    start = F.array().cast(f"array<{cell}>")
    return queue.select(F.explode(F.aggregate("queue", start, take)).alias("c")).select("c.pid", "c.peel_no")


def causes_of(signals: DataFrame, rollup: DataFrame, merchants: DataFrame,
              coverage: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(roots, causes, echoes)``: peeled from the root, then rescued from signals the peel left out."""
    roots = stage(root_problems(root_signals(signals), merchants), "roots")
    causes, echoes = peel(rollup, _as_problems(roots), coverage)
    causes = causes.withColumn("origin", F.lit("peel"))
    asked = unexplained(signals, causes).join(merchants.select("merchant_id", F.col("delta_pp").alias("m_delta")), "merchant_id")
    asked = stage(asked.withColumns({
        "pid": F.concat_ws("@", F.col("minute").cast("string"), "cell_key"),
        "root_expected": F.col("expected_rate"),
        "delta_pp": F.coalesce("m_delta", F.lit(DELTA_PP_DEFAULT)),
    }), "unexplained")
    if not asked.isEmpty():
        more, more_echoes = peel(rollup, _as_problems(asked), coverage)
        accepted = stage(accept_rescues(asked, more), "accepted")
        causes = causes.unionByName(more.join(accepted, ["pid", "peel_no"], "left_semi").withColumn("origin", F.lit("rescue")))
        echoes = echoes.unionByName(more_echoes.join(accepted, ["pid", "peel_no"], "left_semi"))
    return roots, causes, echoes


def _confirmed(roots: DataFrame, causes: DataFrame) -> DataFrame:
    streak = roots.select("bucket", *ROOT_DIMS, "consecutive_windows")
    return causes.join(streak, ["bucket", *ROOT_DIMS], "inner").select(
        "pid", "peel_no", "origin", "bucket", "minute", *DIMS, "attempts", "approved",
        F.col("observed").alias("observed_rate"), F.col("expected").alias("expected_rate"),
        F.lit("cross_sectional").alias("expected_source"), "delta_pp", "ci_low", "ci_high",
        F.lit("1m").alias("window_used"), "consecutive_windows", F.col("explained").alias("explained_deficit"),
        F.lit("CONFIRMED").alias("confidence"), F.col("expected").alias("measured_against"),
    )


def _inconclusive(roots: DataFrame, causes: DataFrame) -> DataFrame:
    """Roots that are down although no child separates: reported with the root signal's numbers."""
    left = roots.join(causes.select("bucket", *ROOT_DIMS).distinct(), ["bucket", *ROOT_DIMS], "left_anti")
    s = F.col("root_signal")
    return left.select(
        "pid", F.lit(0).alias("peel_no"), F.lit("root").alias("origin"), "bucket", "minute", *DIMS,
        s["attempts"].alias("attempts"), s["approved"].alias("approved"), s["observed_rate"].alias("observed_rate"),
        s["expected_rate"].alias("expected_rate"), s["expected_source"].alias("expected_source"), "delta_pp",
        s["ci_low"].alias("ci_low"), s["ci_high"].alias("ci_high"), s["window_used"].alias("window_used"),
        "consecutive_windows",
        F.greatest(F.lit(0.0), s["attempts"] * F.col("root_expected") - s["approved"]).alias("explained_deficit"),
        F.lit("INCONCLUSIVE").alias("confidence"), F.col("root_expected").alias("measured_against"),
    )


def with_explanation(found: DataFrame, rollup: DataFrame, declines: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add onset, impact, decline mix, outage attribution and causal dimension."""
    cells = found.select(*DIMS, (F.col("minute") - ONSET_LOOKBACK_MIN).alias("from_minute"), F.col("minute").alias("to_minute"))
    series = cell_series(rollup, cells, tuple(IMPACT_SERIES))
    timed = with_onset(collect_lookback(found, series, IMPACT_SERIES), calendar(rollup), "measured_against")
    priced = with_impact(timed, "measured_against").drop("seen", "evidence_minutes", "run_thick")

    asked = found.where(F.col("confidence") == "CONFIRMED")
    shifts = stage(decline_shifts(declines, asked, catalog), "shifts")
    lead = dominant(shifts)
    totals = window_totals(declines, asked).where("total_declines > 0").withColumnRenamed("window_min", "mix_window_min")
    spread = outage_attribution(declines, outage_scopes(asked, lead)).select("request_id", "attribution")
    full = (
        priced.join(totals, "request_id", "left")
        .join(shift_arrays(shifts), "request_id", "left")
        .join(lead.drop("window_min"), "request_id", "left")
        .join(spread, "request_id", "left")
    )
    dimension = (
        F.when(F.col("attribution") == "PROVIDER", "provider")
        .when(F.col("attribution") == "ISSUER", "issuer")
        .when(F.col("issuer_id").isNotNull(), "issuer")
        .when(F.col("provider_id").isNotNull(), "provider")
        .when(F.col("payment_method").isNotNull(), "method")
        .otherwise("merchant")
    )
    return full.withColumn("causal_dimension", dimension)


def diagnose(signals: DataFrame, rollup: DataFrame, declines: DataFrame, merchants: DataFrame, coverage: DataFrame,
             catalog: DataFrame) -> DataFrame:
    """Every diagnosis of every minute, with its echoes as an array."""
    roots, causes, echoes = causes_of(signals, rollup, merchants, coverage)
    causes = stage(causes, "causes")
    found = _confirmed(roots, causes).unionByName(_inconclusive(roots, causes)).withColumn(
        "request_id", F.concat_ws("#", "pid", F.col("peel_no").cast("string"))
    )
    found = stage(found, "found")
    by_cause = echoes.withColumn("request_id", F.concat_ws("#", "pid", F.col("peel_no").cast("string"))).groupBy(
        "request_id"
    ).agg(F.array_sort(F.collect_list(F.struct("key", "observed", "residual_rate"))).alias("echoes"))
    none = F.array().cast("array<struct<key:string,observed:double,residual_rate:double>>")
    return with_explanation(found, rollup, declines, catalog).join(by_cause, "request_id", "left").withColumn(
        "echoes", F.coalesce("echoes", none)
    )
