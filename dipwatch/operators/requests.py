"""Slice queries: each takes a table of requested slices, with a country or without, and answers all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipwatch.constants import DIMS, HISTORY_MIN, MIN_VOLUME, ONSET_LOOKBACK_MIN
from dipwatch.functions.cells import cell_key
from dipwatch.functions.minutes import blocks_between, bucket_of
from dipwatch.functions.stats import DROP, THIN, rate, with_verdict
from dipwatch.operators.impact import IMPACT_SERIES, with_costs
from dipwatch.operators.onset import SERIES, collect_lookback, with_onset
from dipwatch.operators.search import peel, residual
from dipwatch.operators.slices import cell_series, join_series


def invalid_reason(prefix: str = "") -> Column:
    """Why a slice cannot be asked about; null when it can."""
    col = lambda d: F.col(f"{prefix}{d}")
    return (
        F.when(col("merchant_id").isNull() | (col("merchant_id") == ""), "merchant_required")
        .when(col("country").isNotNull() & ~col("country").isin("AR", "MX", "BR"), "unknown_country")
        .when(col("payment_method").isNotNull() & ~col("payment_method").isin("CARD", "PIX"), "unknown_method")
        .when((col("payment_method") == "PIX") & col("country").isNotNull() & (col("country") != "BR"), "pix_outside_br")
        .when((col("payment_method") == "PIX") & col("issuer_id").isNotNull() & (col("issuer_id") != "NA"), "pix_with_issuer")
    )


def with_parent(requests: DataFrame) -> DataFrame:
    """Parent of each slice: without its issuer, else its method, else its provider."""
    split = F.when(F.col("issuer_id").isNotNull(), "issuer_id").when(
        F.col("payment_method").isNotNull(), "payment_method"
    ).when(F.col("provider_id").isNotNull(), "provider_id")
    out = requests.withColumn("split_dim", split)
    return out.withColumns({
        f"parent_{d}": F.when(F.coalesce(F.col("split_dim") == d, F.lit(False)), F.lit(None)).otherwise(F.col(d))
        for d in DIMS
    })


def conversion_slice(rollup: DataFrame, requests: DataFrame, merchants: DataFrame) -> DataFrame:
    """Verdict of each slice: reference from siblings, else own past, else the merchant's rate."""
    asked = with_parent(requests).join(merchants, "merchant_id", "inner")
    own = asked.select(
        "request_id", F.lit("own").alias("role"), *DIMS, "minute", (F.col("minute") - HISTORY_MIN).alias("from_minute"),
        F.col("minute").alias("to_minute"),
    )
    parent = asked.where(F.col("split_dim").isNotNull()).select(
        "request_id", F.lit("parent").alias("role"), *[F.col(f"parent_{d}").alias(d) for d in DIMS], "minute",
        F.col("minute").alias("from_minute"), F.col("minute").alias("to_minute"),
    )
    both = own.unionByName(parent)
    series = cell_series(rollup, both, ("attempts", "approved"), any_country=True)
    joined = join_series(both, series, SERIES)
    now = F.col("row_minute") == F.col("minute")
    mine, above = F.col("role") == "own", F.col("role") == "parent"

    def total(condition, name):
        return F.coalesce(F.sum(F.when(condition, F.col(f"row_{name}"))), F.lit(0).cast("bigint"))

    sums = joined.groupBy("request_id").agg(
        total(mine & now, "attempts").alias("attempts"), total(mine & now, "approved").alias("approved"),
        total(above & now, "attempts").alias("_pn"), total(above & now, "approved").alias("_pk"),
        total(mine & (F.col("row_minute") < F.col("minute")), "attempts").alias("_hn"),
        total(mine & (F.col("row_minute") < F.col("minute")), "approved").alias("_hk"),
    )
    split = F.col("split_dim").isNotNull()
    sibling = F.when(split, rate(F.col("_pk") - F.col("approved"), F.col("_pn") - F.col("attempts")))
    past = rate(F.col("_hk"), F.col("_hn"))
    answered = asked.select("request_id", "bucket", *DIMS, "split_dim", "delta_pp", "expected_conversion").join(
        sums, "request_id", "inner"
    ).withColumns({
        "conversion_rate": rate(F.col("approved"), F.col("attempts")),
        "expected": F.coalesce(sibling, past, F.col("expected_conversion")),
        "expected_source": F.when(sibling.isNotNull(), "cross_sectional").when(past.isNotNull(), "temporal").otherwise("absolute"),
    })
    return with_verdict(answered, "approved", "attempts", "expected", "delta_pp").drop(
        "_pn", "_pk", "_hn", "_hk", "expected_conversion"
    )


def conversion_history(rollup: DataFrame, requests: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per request one row for every processed bucket in ``[from_minute, to_minute)``, zero-filled."""
    ranged = requests.withColumn("to_minute", F.col("to_minute") - 1)
    series = cell_series(rollup, ranged, ("attempts", "approved"), any_country=True)
    spine = ranged.withColumn("block", F.explode(blocks_between(F.col("from_minute"), F.col("to_minute")))).join(
        calendar, "block", "inner"
    ).select(
        "request_id", *DIMS,
        F.explode(F.filter("minutes", lambda m: (m >= F.col("from_minute")) & (m <= F.col("to_minute")))).alias("minute"),
    )
    a, s = spine.alias("a"), series.alias("s")
    on = [F.col("a.minute") == F.col("s.minute")] + [F.col(f"a.{d}").eqNullSafe(F.col(f"s.{d}")) for d in DIMS]
    zero = F.lit(0).cast("bigint")
    return a.join(s, on, "left").select(
        "request_id", bucket_of(F.col("a.minute")).alias("bucket"),
        F.coalesce("s.attempts", zero).alias("attempts"), F.coalesce("s.approved", zero).alias("approved"),
        rate(F.col("s.approved"), F.col("s.attempts")).alias("conversion_rate"),
    )


def residual_test(rollup: DataFrame, requests: DataFrame, merchants: DataFrame, coverage: DataFrame) -> DataFrame:
    """Is the candidate the root's cause, an echo of another cell, or not decidable?

    ``requests``: request_id, minute, bucket, the root cell and
    ``candidate_dim`` / ``candidate_value``.
    """
    asked = requests.join(merchants, "merchant_id", "inner").withColumns({
        f"candidate_{d}": F.when(F.col("candidate_dim") == d, F.col("candidate_value")).otherwise(F.col(d)) for d in DIMS
    }).withColumn("candidate_key", cell_key("candidate_"))
    problems = asked.select(
        F.col("request_id").alias("pid"), "bucket", "minute", F.col("expected_conversion").alias("root_expected"),
        "delta_pp", *DIMS,
    )
    causes, echoes = peel(rollup, problems, coverage)
    whole = residual(rollup, problems, _cells(asked).where(F.lit(False)))
    without = residual(rollup, problems, _cells(asked))
    named = causes.select(F.col("pid").alias("request_id"), F.col("key").alias("candidate_key"), "explained", "peel_no")
    root = whole.select(F.col("pid").alias("request_id"), F.col("attempts").alias("root_n"), F.col("rate").alias("root_rate"),
                        F.col("state").alias("root_state"))
    rest = without.select(F.col("pid").alias("request_id"), F.col("rate").alias("rest_rate"))
    silent = echoes.groupBy(F.col("pid").alias("request_id"), "peel_no").agg(F.count(F.lit(1)).alias("echo_count"))
    joined = (
        asked.join(root, "request_id", "inner").join(rest, "request_id", "left")
        .join(named, ["request_id", "candidate_key"], "left").join(silent, ["request_id", "peel_no"], "left")
    )
    enough = F.col("root_n") >= MIN_VOLUME
    matched = F.col("explained").isNotNull()
    before = F.coalesce("root_rate", F.lit(0.0))
    return joined.select(
        "request_id", "bucket", "candidate_key",
        F.when(~enough | (F.col("root_state") != DROP), THIN).when(matched, "ROOT_CAUSE").otherwise("ECHO").alias("verdict"),
        F.when(enough, F.coalesce("explained", F.lit(0.0))).otherwise(0.0).alias("explained_deficit"),
        F.when(enough, (F.coalesce("rest_rate", before) - before) * 100).otherwise(0.0).alias("residual_delta_pp"),
        F.when(enough & matched, F.coalesce("echo_count", F.lit(0))).otherwise(0).alias("echo_count"),
    )


def _cells(asked: DataFrame) -> DataFrame:
    return asked.select(F.col("request_id").alias("pid"), *[F.col(f"candidate_{d}").alias(f"cell_{d}") for d in DIMS])


def incident_onset(rollup: DataFrame, requests: DataFrame, calendar: DataFrame) -> DataFrame:
    """Onset without the three-window floor, with the minutes that make up the run."""
    cells = requests.withColumn("from_minute", F.col("minute") - ONSET_LOOKBACK_MIN).withColumn("to_minute", F.col("minute"))
    found = with_onset(collect_lookback(requests, cell_series(rollup, cells, ("attempts", "approved"), any_country=True), SERIES), calendar)
    run = F.col("evidence_minutes")
    return found.select(
        "request_id",
        bucket_of(F.coalesce(F.try_element_at(run, F.lit(1)), F.col("minute"))).alias("started_at"),
        (F.col("run_thick") > 0).alias("started_at_exact"),
        F.when(F.size(run) > 0, run).otherwise(F.array("minute")).alias("evidence_minutes"),
    )


def incident_impact(rollup: DataFrame, requests: DataFrame) -> DataFrame:
    """Impact of each slice over ``[started_minute, minute]``, however long that is."""
    ranged = requests.withColumn("from_minute", F.col("started_minute")).withColumn("to_minute", F.col("minute"))
    joined = join_series(ranged, cell_series(rollup, ranged, tuple(IMPACT_SERIES), any_country=True), IMPACT_SERIES)
    zero = F.lit(0).cast("bigint")
    sums = joined.groupBy(*requests.columns).agg(
        *[F.coalesce(F.sum(f"row_{c}"), zero).alias(f"_{c}") for c in IMPACT_SERIES]
    )
    priced = with_costs(sums.withColumn("duration_min", F.col("minute") - F.col("started_minute") + 1), "expected")
    return priced.withColumn("cost_usd_per_min", F.round("cost_usd_per_min").cast("bigint")).drop(
        *[f"_{c}" for c in IMPACT_SERIES]
    )
