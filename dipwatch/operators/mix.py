"""Decline mix of a cell: which codes moved, and what an outage code points at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from dipwatch.constants import (DECLINE_CURRENT_LOOKBACK_MIN, DECLINE_HISTORY_LOOKBACK_MIN, DECLINE_WINDOWS_MIN, DIMS,
                                MIN_DECLINES, OUTAGE_CODES, ROOT_DIMS, TEMPORAL_MIN_DECLINES)
from dipwatch.functions.minutes import block_of, blocks_between
from dipwatch.functions.stats import wilson
from dipwatch.operators.slices import cell_series, join_series

_REACH = DECLINE_CURRENT_LOOKBACK_MIN - 1 + DECLINE_HISTORY_LOOKBACK_MIN
SHIFT_COLUMNS = ["code", "family", "diagnostic", "count", "observed_share", "reference_share", "moved_pp"]


def code_counts(declines: DataFrame, requests: DataFrame) -> DataFrame:
    """Declines per request and code in the 1, 5 and 15 minute windows and in its history.

    ``requests`` needs ``request_id``, the cell and ``minute``. All windows come
    from one range join over the (cell, code, minute) sums.
    """
    ranged = requests.select("request_id", *DIMS, "minute").withColumn(
        "from_minute", F.col("minute") - F.lit(_REACH)
    ).withColumn("to_minute", F.col("minute"))
    series = cell_series(declines, ranged, ("declines",), ("decline_code",), any_country=True)
    joined = join_series(ranged, series, ["decline_code", "declines"]).where(F.col("row_minute").isNotNull())
    age = F.col("minute") - F.col("row_minute")
    amount = F.col("row_declines")
    windows = {f"count_{w}": age < w for w in DECLINE_WINDOWS_MIN}
    windows["count_history"] = age >= DECLINE_CURRENT_LOOKBACK_MIN
    return joined.groupBy("request_id", F.col("row_decline_code").alias("code")).agg(
        *[F.coalesce(F.sum(F.when(inside, amount)), F.lit(0)).alias(name) for name, inside in windows.items()]
    )


def decline_shifts(declines: DataFrame, requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per request and catalogued code seen in its chosen window.

    The window widens until it holds enough declines. Codes missing from the
    catalogue count in the total but have no row of their own.
    """
    counts = code_counts(declines, requests)
    over = Window.partitionBy("request_id")
    w1, w5, w15 = DECLINE_WINDOWS_MIN
    totals = counts
    for name in (f"count_{w1}", f"count_{w5}", f"count_{w15}", "count_history"):
        totals = totals.withColumn(f"total_{name}", F.sum(name).over(over))
    chosen = F.when(F.col(f"total_count_{w1}") >= MIN_DECLINES, w1).when(
        F.col(f"total_count_{w5}") >= MIN_DECLINES, w5
    ).otherwise(w15)

    def by_window(prefix: str):
        return F.when(F.col("window_min") == w1, F.col(f"{prefix}_{w1}")).when(
            F.col("window_min") == w5, F.col(f"{prefix}_{w5}")
        ).otherwise(F.col(f"{prefix}_{w15}"))

    picked = totals.withColumn("window_min", chosen).withColumns({
        "count": by_window("count"), "total_declines": by_window("total_count"),
    }).where(F.col("count") > 0)
    own_history = F.col("total_count_history") >= TEMPORAL_MIN_DECLINES
    named = picked.join(catalog.select("code", "family", "diagnostic", "baseline_share"), "code", "inner")
    observed = F.col("count").cast("double") / F.col("total_declines")
    reference = F.when(own_history, F.col("count_history").cast("double") / F.col("total_count_history")).otherwise(
        F.col("baseline_share")
    )
    return named.withColumns({
        "observed_share": observed,
        "reference_share": reference,
        "reference_source": F.when(own_history, "temporal").otherwise("catalog"),
    }).withColumn("moved_pp", (F.col("observed_share") - F.col("reference_share")) * 100).select(
        "request_id", "window_min", "total_declines", "reference_source", *SHIFT_COLUMNS
    )


def window_totals(declines: DataFrame, requests: DataFrame) -> DataFrame:
    """Window, total and reference source of every request, also without catalogued codes."""
    counts = code_counts(declines, requests).groupBy("request_id").agg(
        *[F.sum(f"count_{w}").alias(f"total_{w}") for w in DECLINE_WINDOWS_MIN],
        F.sum("count_history").alias("total_history"),
    )
    w1, w5, w15 = DECLINE_WINDOWS_MIN
    joined = requests.select("request_id").join(counts, "request_id", "left").fillna(0)
    return joined.select(
        "request_id",
        F.when(F.col(f"total_{w1}") >= MIN_DECLINES, w1).when(F.col(f"total_{w5}") >= MIN_DECLINES, w5)
        .otherwise(w15).alias("window_min"),
        F.when(F.col(f"total_{w1}") >= MIN_DECLINES, F.col(f"total_{w1}"))
        .when(F.col(f"total_{w5}") >= MIN_DECLINES, F.col(f"total_{w5}")).otherwise(F.col(f"total_{w15}"))
        .alias("total_declines"),
        F.when(F.col("total_history") >= TEMPORAL_MIN_DECLINES, "temporal").otherwise("catalog").alias("reference_source"),
    )


def dominant(shifts: DataFrame) -> DataFrame:
    """The diagnostic code carrying the largest share, if its rise is supported.

    Keeps one row per request that has a dominant code.
    """
    first = Window.partitionBy("request_id").orderBy(F.desc("observed_share"), "code")
    leading = shifts.where("diagnostic").withColumn("_place", F.row_number().over(first)).where("_place = 1")
    low, _ = wilson("`count`", "total_declines")
    return leading.where(low > F.col("reference_share")).select(
        "request_id", F.col("code").alias("dominant_code"), F.col("family").alias("dominant_family"), "window_min"
    )


def shift_arrays(shifts: DataFrame) -> DataFrame:
    """Shifts of each request as one array, largest movement first."""
    entry = F.struct(
        (-F.col("moved_pp")).alias("_order"), *[F.col(c) for c in SHIFT_COLUMNS]
    )
    return shifts.groupBy("request_id").agg(
        F.transform(
            F.array_sort(F.collect_list(entry)),
            lambda e: F.struct(*[e[c].alias(c) for c in SHIFT_COLUMNS]),
        ).alias("shifts")
    )


def outage_attribution(declines: DataFrame, scopes: DataFrame) -> DataFrame:
    """Whether an outage code points at a provider, an issuer or the rail.

    ``scopes``: request_id, merchant_id, country, minute, window_min, code. The
    spread is read over the whole root, wider than the causal cell.
    """
    ranged = scopes.withColumn("from_minute", F.col("minute") - F.col("window_min") + 1)
    blocked = ranged.withColumn("block", F.explode(blocks_between(F.col("from_minute"), F.col("minute")))).alias("a")
    rows = declines.withColumn("block", block_of(F.col("minute"))).alias("s")
    on = [F.col("a.block") == F.col("s.block"), F.col("a.code") == F.col("s.decline_code")]
    on += [F.col(f"a.{d}") == F.col(f"s.{d}") for d in ROOT_DIMS]
    on += [F.col("s.minute").between(F.col("a.from_minute"), F.col("a.minute")), F.col("s.declines") > 0]
    spread = blocked.join(rows, on, "left").groupBy(F.col("a.request_id").alias("request_id")).agg(
        F.count("s.minute").alias("rows"),
        F.count_distinct("s.provider_id").alias("providers"),
        F.count_distinct(F.when(F.col("s.issuer_id") != "NA", F.col("s.issuer_id"))).alias("issuers"),
        F.count(F.when(F.col("s.payment_method") != "PIX", 1)).alias("not_pix"),
    )
    verdict = (
        F.when(F.col("rows") == 0, "INCONCLUSIVE")
        .when(F.col("not_pix") == 0, F.when(F.col("providers") >= 2, "RAIL").otherwise("INCONCLUSIVE"))
        .when((F.col("providers") == 1) & (F.col("issuers") >= 2), "PROVIDER")
        .when((F.col("issuers") == 1) & (F.col("providers") >= 2), "ISSUER")
        .otherwise("INCONCLUSIVE")
    )
    return spread.select("request_id", "providers", "issuers", verdict.alias("attribution"))


def outage_scopes(requests: DataFrame, dominants: DataFrame) -> DataFrame:
    return requests.select("request_id", *ROOT_DIMS, "minute").join(
        dominants.where(F.col("dominant_code").isin(*OUTAGE_CODES)).withColumnRenamed("dominant_code", "code"),
        "request_id", "inner",
    )
