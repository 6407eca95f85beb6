"""Report columns: tiers, labels, formats and the two template narratives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipwatch import catalogs as C
from dipwatch.constants import DIMS

# Names and phrases of the report: fixed wording, as are the two narratives below.
COUNTRY_NAMES = [("BR", "Brazil"), ("MX", "Mexico"), ("AR", "Argentina")]
SOURCE_PHRASES = [
    ("cross_sectional", "vs. its siblings this window"),
    ("temporal", "vs. its own recent history"),
    ("absolute", "vs. the merchant's configured baseline"),
]


def tier_of(cost_usd_per_min: Column) -> Column:
    """Severity by minor units per minute."""
    return F.when(cost_usd_per_min >= 20000, "critical").when(cost_usd_per_min >= 3000, "warn").otherwise("ok")


def with_badges(found: DataFrame) -> DataFrame:
    tier = tier_of(F.col("cost_usd_per_min"))
    label = F.when(tier == "critical", "Critical").when(tier == "warn", "Warning").otherwise("Confirmed")
    return found.withColumns({
        "tier": F.when(F.col("status") == "open", tier).when(F.col("status").isin("monitoring", "resolved"), F.col("status"))
        .otherwise("inconclusive"),
        "badge": F.when(F.col("status") == "open", label).otherwise(F.initcap("status")),
        "cause_label": F.when(F.col("confidence") == "CONFIRMED", "Cause isolated").when(
            F.col("confidence") == "INCONCLUSIVE", "Cause not isolated"
        ),
    })


def fixed(value: Column, digits: int = 1) -> Column:
    """Decimal text of the exact binary value, half-way cases away from zero.

    The scaled value is split into the rounded product and its error (both exact in doubles), since a formatter
    that starts from the shortest decimal would round 12.45, which is a little less than its text, up.
    """
    size, scale = F.abs(value), float(10 ** digits)
    product = size * scale
    high = size * 134217729.0 - (size * 134217729.0 - size)
    error = (high * scale - product) + (size - high) * scale
    whole = F.floor(product)
    part = product - whole
    up = (part > 0.5) | ((part == 0.5) & (error >= 0))
    n = whole + F.when(up, 1).otherwise(0)
    units = 10 ** digits
    text = F.floor(n / units).cast("bigint").cast("string")
    if digits:
        text = F.concat(text, F.lit("."), F.lpad((n % units).cast("bigint").cast("string"), digits, "0"))
    return F.concat(F.when(value < 0, "-").otherwise(""), text)


def percent(value: Column, digits: int = 1) -> Column:
    return F.concat(fixed(value * 100, digits), F.lit("%"))


def signed_pp(value: Column) -> Column:
    sign = F.when(value > 0, "+").when(value < 0, "−").otherwise("")
    return F.concat(sign, fixed(F.abs(value)), F.lit("pp"))


def money(minor: Column, prefix: str | Column = "US$") -> Column:
    """Compact amount: thousands as ``1.2k``, the rest as a grouped integer."""
    value = minor.cast("double") / 100
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    text = F.when(F.abs(value) >= 1000, F.concat(fixed(value / 1000), F.lit("k"))).otherwise(
        F.format_number(F.round(value), 0)
    )
    return F.concat(prefix, F.lit(" "), text)


def minutes_since(started: Column, exact: Column, now: Column) -> Column:
    minutes = F.greatest(F.lit(0), F.round((F.unix_seconds(now) - F.unix_seconds(started)) / 60).cast("bigint"))
    label = F.when(minutes < 1, "just now").when(minutes == 1, "1 min ago").otherwise(
        F.concat(minutes.cast("string"), F.lit(" min ago"))
    )
    return F.when(exact, label).otherwise(F.concat(F.lit("≈ "), label))


def with_names(rows: DataFrame) -> DataFrame:
    """Catalogue names of the dimension values, the id itself when unknown."""
    spark = rows.sparkSession
    tables = {
        "provider_id": C.named(spark, C.PROVIDERS, "provider_id"),
        "issuer_id": C.named(spark, C.ISSUERS, "issuer_id"),
        "merchant_id": C.named(spark, C.MERCHANTS, "merchant_id"),
        "country": C.named(spark, COUNTRY_NAMES, "country"),
    }
    out = rows
    for key, table in tables.items():
        short = key.removesuffix("_id")
        out = out.join(table.withColumnRenamed("name", f"_{short}"), key, "left").withColumn(
            f"{short}_name", F.coalesce(f"_{short}", key)
        ).drop(f"_{short}")
    return out


def dimension_label() -> Column:
    parts = F.concat_ws(" · ", "provider_name", "country_name", "payment_method", "issuer_name", "merchant_name")
    return F.when(parts == "", "the whole portfolio").otherwise(parts)


def report(evidence: DataFrame, playbooks: DataFrame) -> DataFrame:
    """Label, headline and both narratives of each evidence row, from its stored fields only."""
    spark = evidence.sparkSession
    labels = spark.sql(C.values_sql(C.DECLINE_LABELS, ("dominant_decline", "decline_label")))
    phrases = spark.sql(C.values_sql(SOURCE_PHRASES, ("expected_source", "phrase")))
    advice = playbooks.select(
        F.when(F.col("causal_dimension") == "payment_method", "method").otherwise(F.col("causal_dimension")).alias("shape"),
        F.lower("title").alias("advice"),
    )
    shape = (
        F.when(F.col("issuer_id").isNotNull(), "issuer").when(F.col("provider_id").isNotNull(), "provider")
        .when(F.col("payment_method").isNotNull(), "method").otherwise("merchant")
    )
    named = with_names(evidence).withColumn("shape", shape)
    joined = named.join(labels, "dominant_decline", "left").join(phrases, "expected_source", "left").join(advice, "shape", "left")
    moved = F.element_at(F.filter("decline_mix", lambda e: e["code"] == F.col("dominant_decline")), 1)
    has_mix = F.col("dominant_decline").isNotNull() & F.exists("decline_mix", lambda e: e["code"] == F.col("dominant_decline"))
    label = dimension_label()
    mix_line = F.when(has_mix, F.concat(
        F.lit(" Code "), "dominant_decline", F.lit(" ("), F.coalesce("decline_label", "dominant_decline"), F.lit(") rose from "),
        percent(moved["baseline_share"], 0), F.lit(" to "), percent(moved["observed_share"], 0), F.lit(" of declines."),
    )).otherwise("")
    windows = F.col("consecutive_windows")
    operations = F.concat(
        label, F.lit(" is confirmed at "), percent(F.col("observed_rate")), F.lit(" against an expected "),
        percent(F.col("expected_rate")), F.lit(" ("), "phrase", F.lit("), over "), F.col("attempts").cast("string"),
        F.lit(" attempts across "), windows.cast("string"), F.lit(" consecutive window"),
        F.when(windows == 1, "").otherwise("s"), F.lit("."), mix_line,
    )
    executive = F.concat(
        F.lit("Losing at least "), money(F.col("cost_usd_per_min")), F.lit("/min on "), label, F.lit(" ("),
        signed_pp(F.col("delta_pp")), F.lit(" vs. expected). Recommended: "), "advice", F.lit("."),
    )
    return joined.select(
        "request_id", "bucket", *DIMS, label.alias("label"), F.concat(label, F.lit(" is degrading")).alias("headline"),
        operations.alias("narrative_ops"), executive.alias("narrative_exec"),
    )


def history(found: DataFrame, status: str | None = None, merchant: str | None = None, text: str | None = None) -> DataFrame:
    """Closed incidents, newest first, filtered like the history list."""
    rows = found.where(~F.col("status").isin("open", "monitoring"))
    if status:
        rows = rows.where(F.col("status") == status)
    if merchant:
        rows = rows.where(F.col("merchant_id") == merchant)
    if text:
        haystack = F.concat_ws("\n", F.lower("fingerprint"), F.lower("label"))
        rows = rows.where(haystack.contains(text.lower()))
    return rows.orderBy(F.desc("detected_at"), "incident_id")
