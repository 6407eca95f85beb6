"""Known fault windows on a payments table, and the grid of declared cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipwatch.constants import DIMS
from dipwatch.functions.minutes import block_of, blocks_between


def label_faults(tx: DataFrame, faults: DataFrame) -> DataFrame:
    """Attach the combined effect of all faults active on each payment.

    Rates multiply, latencies add, decline weights of later faults override.
    Faults with an end are grouped per day into one array, so payments are
    joined on the day only and never shuffled or multiplied; those without an
    end are one array for all days. Which faults apply is decided inside the
    row. ``faults``: fault_id, place (order), starts_at, ends_at or null, the
    five dimensions or null, conversion_multiplier, latency_ms_increase,
    decline_weights.
    """
    minute = lambda c: F.expr(f"unix_seconds({c}) div 60")
    effect = F.struct(
        "place", "fault_id", "starts_at", "ends_at", *DIMS, "conversion_multiplier",
        F.coalesce("latency_ms_increase", F.lit(0).cast("bigint")).alias("latency_ms_increase"),
        F.coalesce("decline_weights", F.create_map().cast("map<string,double>")).alias("decline_weights"),
    )
    bounded = faults.where(F.col("ends_at").isNotNull())
    daily = bounded.withColumn("_day", F.explode(blocks_between(minute("starts_at"), F.greatest(minute("starts_at"), minute("ends_at"))))).groupBy(
        "_day").agg(F.collect_list(effect).alias("_dated"))
    lasting = faults.where(F.col("ends_at").isNull()).agg(F.collect_list(effect).alias("f")).scalar()
    joined = tx.withColumn("_day", block_of(minute("created_at"))).join(daily, "_day", "left").withColumn("_faults", F.when(
        F.col("_dated").isNull(), lasting).otherwise(F.concat("_dated", lasting))).drop("_dated")
    dims = " AND ".join(f"(f.{d} IS NULL OR f.{d} = {d})" for d in DIMS)
    active = F.expr(
        "array_sort(filter(_faults, f -> f.starts_at <= created_at"
        f" AND (f.ends_at IS NULL OR created_at < f.ends_at) AND {dims}), (a, b) -> int(sign(a.place - b.place)))"
    )
    return joined.withColumn("_active", active).withColumns({
        "fault_ids": F.expr("transform(_active, f -> f.fault_id)"),
        "conversion_multiplier": F.expr("aggregate(_active, 1D, (total, f) -> total * f.conversion_multiplier)"),
        "latency_ms_increase": F.expr("aggregate(_active, 0L, (total, f) -> total + f.latency_ms_increase)"),
        "decline_weights": F.expr(
            "aggregate(_active, cast(map() AS map<string,double>), (held, f) -> map_concat("
            "map_filter(held, (k, v) -> NOT map_contains_key(f.decline_weights, k)), f.decline_weights))"
        ),
    }).drop("_day", "_faults", "_active")


def cell_grid(merchants: DataFrame, coverage: DataFrame, issuers: DataFrame) -> DataFrame:
    """Declared cells: each merchant over its country's routes and, for card, its issuers."""
    routes = merchants.select("merchant_id", "country").join(coverage, "country", "inner")
    card = routes.where(F.col("payment_method") != "PIX").join(issuers.select("issuer_id", "country"), "country", "inner")
    pix = routes.where(F.col("payment_method") == "PIX").withColumn("issuer_id", F.lit("NA"))
    return card.select(*DIMS).unionByName(pix.select(*DIMS))


def silent_cells(grid: DataFrame, rollup: DataFrame) -> DataFrame:
    """Declared cells without any traffic."""
    return grid.join(rollup.select(*DIMS).distinct(), list(DIMS), "left_anti")


def undeclared_cells(grid: DataFrame, rollup: DataFrame) -> DataFrame:
    """Traffic outside the declared grid."""
    return rollup.groupBy(*DIMS).agg(F.sum("attempts").alias("attempts")).join(grid, list(DIMS), "left_anti")
