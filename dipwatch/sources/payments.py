"""The payments fact, derived from the order-line table.

A payment attempt is one order line; ``transaction_id`` repeats, so the raw
table carries re-deliveries that the ingest has to drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dipwatch.operators.rollup import first_write

RAW_COLUMNS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
WRITE_ORDER = ("l_partkey", "l_suppkey", "l_extendedprice")

# 2026-08-30 12:00:00 UTC as epoch minutes, and the number of minutes covered.
FIRST_MINUTE = 29801520
MINUTES = 30

ISSUERS_BY_COUNTRY = {
    "BR": ("itau", "nubank", "bradesco"),
    "MX": ("bbva_mx", "banorte", "citibanamex"),
    "AR": ("galicia", "santander_rio", "macro"),
}
# Upper ends (exclusive) of the decline-code ranges over 0..999.
PIX_CODES = ((550, "AM05"), (700, "AB03"), (800, "DS0G"), (880, "BE01"), (950, "CH11"), (1000, "BE17"))
CARD_CODES = (
    (340, "05"), (600, "51"), (710, "54"), (790, "01"), (820, "59"), (850, "57"), (880, "62"), (900, "1A"),
    (920, "34"), (940, "63"), (960, "65"), (975, "14"), (985, "04"), (990, "41"), (995, "43"), (1000, "61"),
)
USD_RATE_PER_1000 = {"AR": 1, "MX": 55, "BR": 180}


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/lineitem.parquet").select(*RAW_COLUMNS)


def with_transaction_id(lines: DataFrame) -> DataFrame:
    return lines.withColumn("transaction_id", F.expr("l_orderkey * 10 + l_linenumber"))


def _ladder(value: Column, ranges) -> Column:
    out = F.lit(None).cast("string")
    for end, code in reversed(ranges):
        out = F.when(value < end, code).otherwise(out)
    return out


def _pick(index: Column, names) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def as_payments(lines: DataFrame) -> DataFrame:
    """Column expressions only; every output derives from one input row."""
    country = _pick(F.expr("l_suppkey % 3"), ("BR", "MX", "AR"))
    pix = (F.col("country") == "BR") & (F.expr("(l_partkey div 3) % 4") == 0)
    turn = F.expr("(l_suppkey div 3) % 3")
    issuer = F.coalesce(*[
        F.when(F.col("country") == c, _pick(turn, names)) for c, names in ISSUERS_BY_COUNTRY.items()
    ])
    fault1 = (
        (F.col("merchant_id") == "BR_STORE_01") & (F.col("provider_id") == "stripe")
        & (F.col("issuer_id") == "itau") & F.col("m").between(12, 20)
    )
    fault2 = (F.col("merchant_id") == "MX_STORE_02") & (F.col("issuer_id") == "bbva_mx") & F.col("m").between(15, 24)
    card_code = (
        F.when(F.col("fault1") & (F.col("v") < 750), "05")
        .when(F.col("fault2") & (F.col("v") < 700), "91")
        .otherwise(_ladder(F.col("v"), CARD_CODES))
    )
    usd = F.coalesce(*[
        F.when(F.col("country") == c, F.expr(f"amount_minor * {r} div 1000")) for c, r in USD_RATE_PER_1000.items()
    ])
    return (
        lines.withColumn("m", F.expr("l_orderkey % 30"))
        .withColumn("country", country)
        .withColumn("merchant_id", F.concat("country", F.lit("_STORE_0"), F.expr("1 + l_partkey % 3").cast("string")))
        .withColumn("provider_id", _pick(F.expr("l_linenumber % 3"), ("mercado_pago", "stripe", "adyen")))
        .withColumn("payment_method", F.when(pix, "PIX").otherwise("CARD"))
        .withColumn("issuer_id", F.when(F.col("payment_method") == "PIX", "NA").otherwise(issuer))
        .withColumn("u", F.expr("(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31 + l_suppkey * 17) % 1000"))
        .withColumn("v", F.expr("(u * 37 + l_partkey) % 1000"))
        .withColumn("fault1", fault1)
        .withColumn("fault2", fault2)
        .withColumn(
            "status",
            F.when(F.col("u") < F.when(F.col("fault1"), 850).when(F.col("fault2"), 700).otherwise(100), "DECLINED")
            .otherwise("SUCCESS"),
        )
        .withColumn(
            "decline_code",
            F.when(F.col("status") == "DECLINED",
                   F.when(F.col("payment_method") == "PIX", _ladder(F.col("v"), PIX_CODES)).otherwise(card_code)),
        )
        .withColumn("amount_minor", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
        .withColumn("amount_usd_minor", usd)
        .withColumn("minute", F.lit(FIRST_MINUTE).cast("bigint") + F.col("m"))
        .select(
            "transaction_id", F.timestamp_seconds(F.col("minute") * 60).alias("created_at"),
            "merchant_id", "provider_id", "country", "payment_method", "issuer_id", "status", "decline_code",
            "amount_minor", "amount_usd_minor",
        )
    )


def raw_payments(spark: SparkSession, folder: str) -> DataFrame:
    """Every delivered attempt, re-deliveries included."""
    return as_payments(with_transaction_id(order_lines(spark, folder)))


def payments(spark: SparkSession, folder: str, parts: int | None = None) -> DataFrame:
    """The stored fact: one row per transaction.

    De-duplication runs on the five numeric source columns, and the eleven
    payment columns are derived afterwards, so the shuffle carries 40 bytes
    per row instead of the wide strings. With ``parts`` the kept rows, still
    narrow, are dealt over that many tasks: for work that takes far longer per
    byte than the sizes show by which Spark joins shuffle partitions.
    """
    lines = first_write(with_transaction_id(order_lines(spark, folder)), ["transaction_id"], list(WRITE_ORDER))
    return as_payments(lines if parts is None else lines.repartition(parts))
