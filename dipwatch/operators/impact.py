"""What a drop cost, never overstated: losses count from the upper end of the interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipwatch.constants import CURRENCY_BY_COUNTRY
from dipwatch.functions.stats import wilson

IMPACT_SERIES = ["attempts", "approved", "amount_minor_sum", "amount_usd_sum"]


def currency_of(country: str = "country") -> Column:
    """Local currency of a country, null when unknown."""
    pairs = [F.lit(x) for pair in CURRENCY_BY_COUNTRY.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.col(country))


def with_impact(collected: DataFrame, expected: str, started: str = "started_minute") -> DataFrame:
    """Add the impact over ``[started, minute]``, both ends included.

    Needs ``seen`` (the cell's minutes), ``minute`` and ``country``.
    """
    inside = F.filter("seen", lambda r: (r["minute"] >= F.col(started)) & (r["minute"] <= F.col("minute")))
    summed = collected.withColumn("_inside", inside)
    summed = summed.withColumns({
        f"_{name}": F.expr(f"aggregate(_inside, 0L, (total, r) -> total + r.{name})") for name in IMPACT_SERIES
    })
    return with_costs(summed.withColumn("duration_min", F.col("minute") - F.col(started) + 1), expected).drop(
        "_inside", *[f"_{c}" for c in IMPACT_SERIES]
    )


def with_costs(summed: DataFrame, expected: str) -> DataFrame:
    """Cost columns from ``_attempts``, ``_approved``, the amounts and ``duration_min``."""
    _, high = wilson("_approved", "_attempts")
    lost = F.round(F.col("_attempts") * F.greatest(F.lit(0.0), F.col(expected) - high)).cast("bigint")

    def ticket(amount: str) -> Column:
        return F.coalesce(F.round(F.try_divide(F.col(amount), F.col("_attempts"))).cast("bigint"), F.lit(0).cast("bigint"))

    out = summed.withColumns({
        "lost_approvals": lost,
        "avg_ticket_usd_minor": ticket("_amount_usd_sum"),
        "avg_ticket_local_minor": ticket("_amount_minor_sum"),
        "currency": currency_of(),
    })
    out = out.withColumns({
        "cost_usd_minor": F.col("lost_approvals") * F.col("avg_ticket_usd_minor"),
        "cost_local_minor": F.when(
            F.col("currency").isNotNull(), F.col("lost_approvals") * F.col("avg_ticket_local_minor")
        ),
    })
    per_minute = F.col("cost_usd_minor").cast("double") / F.col("duration_min")
    return out.withColumns({
        "cost_local": F.when(
            F.col("currency").isNotNull(), F.create_map(F.col("currency"), F.col("cost_local_minor"))
        ).otherwise(F.create_map().cast("map<string,bigint>")),
        "cost_usd_per_min": per_minute,
        "priority_score": per_minute,
    })
