"""Catalogue tables. The rows below are fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MERCHANTS = [
    ("AR_STORE_01", "Pampa Digital", "AR"),
    ("AR_STORE_02", "Rivera Tienda", "AR"),
    ("AR_STORE_03", "Andes Mercado", "AR"),
    ("BR_STORE_01", "Aurora Marketplace", "BR"),
    ("BR_STORE_02", "Vitrine Prime", "BR"),
    ("BR_STORE_03", "Rota Sul Comercio", "BR"),
    ("MX_STORE_01", "Sol Azteca Retail", "MX"),
    ("MX_STORE_02", "Delta Norte Shop", "MX"),
    ("MX_STORE_03", "Casa Maya Online", "MX"),
]
PROVIDERS = [("stripe", "Stripe"), ("adyen", "Adyen"), ("mercado_pago", "Mercado Pago")]
ISSUERS = [
    ("itau", "Itau", "BR"),
    ("nubank", "Nubank", "BR"),
    ("bradesco", "Bradesco", "BR"),
    ("bbva_mx", "BBVA Mexico", "MX"),
    ("banorte", "Banorte", "MX"),
    ("citibanamex", "Citibanamex", "MX"),
    ("galicia", "Galicia", "AR"),
    ("santander_rio", "Santander Rio", "AR"),
    ("macro", "Macro", "AR"),
]
COUNTRY_METHODS = [("AR", "CARD"), ("MX", "CARD"), ("BR", "CARD"), ("BR", "PIX")]
COVERAGE = [(p, c, m) for p, _ in PROVIDERS for c, m in COUNTRY_METHODS]

# (code, payment_method, family, baseline_share, diagnostic)
DECLINE_CODES = [
    ("05", "CARD", "issuer", 0.32, True),
    ("51", "CARD", "funds", 0.26, False),
    ("54", "CARD", "credential", 0.11, False),
    ("01", "CARD", "issuer", 0.08, True),
    ("59", "CARD", "fraud", 0.03, True),
    ("57", "CARD", "issuer", 0.03, True),
    ("62", "CARD", "issuer", 0.03, True),
    ("1A", "CARD", "auth", 0.02, True),
    ("34", "CARD", "fraud", 0.02, True),
    ("63", "CARD", "fraud", 0.02, True),
    ("65", "CARD", "auth", 0.02, True),
    ("91", "CARD", "network", 0.02, True),
    ("14", "CARD", "credential", 0.015, False),
    ("04", "CARD", "fraud", 0.01, False),
    ("41", "CARD", "fraud", 0.005, False),
    ("43", "CARD", "fraud", 0.005, False),
    ("61", "CARD", "funds", 0.005, False),
    ("AM05", "PIX", "funds", 0.55, False),
    ("AB03", "PIX", "network", 0.15, True),
    ("DS0G", "PIX", "fraud", 0.1, True),
    ("BE01", "PIX", "credential", 0.08, False),
    ("CH11", "PIX", "credential", 0.07, False),
    ("BE17", "PIX", "merchant", 0.05, True),
]
DECLINE_LABELS = [
    ("01", "Refer to card issuer"),
    ("04", "Pick up card"),
    ("05", "Do not honor"),
    ("14", "Invalid card number"),
    ("1A", "Authentication required (SCA)"),
    ("34", "Suspected fraud (pick up)"),
    ("41", "Lost card"),
    ("43", "Stolen card"),
    ("51", "Insufficient funds or limit"),
    ("54", "Expired card"),
    ("57", "Transaction not permitted to cardholder"),
    ("59", "Suspected fraud"),
    ("61", "Amount or usage limit exceeded"),
    ("62", "Restricted card"),
    ("63", "Security violation"),
    ("65", "Authentication required (attempts exceeded)"),
    ("91", "Issuer unavailable"),
    ("AB03", "SPI timeout"),
    ("AM05", "Insufficient funds"),
    ("BE01", "CPF/CNPJ mismatch"),
    ("BE17", "Receiver rejected (inactive account)"),
    ("CH11", "Invalid payer identification"),
    ("DS0G", "Transaction not authorized (fraud prevention)"),
]
# (file order, playbook_id, causal_dimension, decline_family, title, owner, summary, two actions)
PLAYBOOKS = [
    (1, "provider-default", "provider", None, "Provider degradation escalation", "provider-ops",
     "Escalate the provider owner and prepare a human-reviewed rerouting proposal.",
     "Open an escalation with the affected provider including the impacted slice and decline evidence.",
     "Prepare a rerouting proposal for human approval before changing traffic."),
    (2, "issuer-default", "issuer", "issuer", "Issuer escalation", "issuer-ops",
     "Escalate the issuer or acquirer contact and monitor the affected slice.",
     "Escalate the impacted issuer or acquirer with the evidence trail and dominant decline family.",
     "Monitor the affected issuer slice until conversion stabilizes."),
    (3, "method-country-default", "payment_method", "network", "Rail or method-country escalation", "rail-ops",
     "Escalate the rail owner and prepare an operational alternative for review.",
     "Escalate the payment rail owner with the provider, country, and method evidence.",
     "Prepare an operational alternative for human approval."),
    (4, "merchant-default", "merchant", "merchant", "Merchant integration review", "merchant-success",
     "Review merchant configuration, integration, and recent changes before any remediation.",
     "Review recent merchant configuration and integration changes in the affected slice.",
     "Contact the merchant owner with the evidence and request manual validation."),
]
EXPECTED_CONVERSION = 0.90
MIN_MATERIAL_DROP_PP = 3.0


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, int):
        return f"CAST({value} AS BIGINT)"
    return "'" + value.replace("'", "''") + "'"


def values_sql(rows, names) -> str:
    """A SELECT over VALUES that both Spark and an ANSI engine accept."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({', '.join(names)})"


MERCHANT_COLUMNS = ("merchant_id", "expected_conversion", "delta_pp")
COVERAGE_COLUMNS = ("provider_id", "country", "payment_method")
CODE_COLUMNS = ("code", "payment_method", "family", "baseline_share", "diagnostic")
PLAYBOOK_COLUMNS = ("file_order", "playbook_id", "causal_dimension", "decline_family", "title", "owner", "summary", "first_action",
                    "second_action")


def merchants_sql(expected: float = EXPECTED_CONVERSION) -> str:
    return values_sql([(m, float(expected), MIN_MATERIAL_DROP_PP) for m, _, _ in MERCHANTS], MERCHANT_COLUMNS)


def coverage_sql() -> str:
    return values_sql(COVERAGE, COVERAGE_COLUMNS)


def codes_sql() -> str:
    return values_sql(DECLINE_CODES, CODE_COLUMNS)


def playbooks_sql() -> str:
    return values_sql(PLAYBOOKS, PLAYBOOK_COLUMNS)


def names_sql(rows, key: str) -> str:
    return values_sql([r[:2] for r in rows], (key, "name"))


# VALUES become local relations, whose size Catalyst knows exactly; that is
# what lets it broadcast them without a hint.
def merchants(spark: SparkSession, expected: float = EXPECTED_CONVERSION) -> DataFrame:
    return spark.sql(merchants_sql(expected))


def coverage(spark: SparkSession) -> DataFrame:
    return spark.sql(coverage_sql())


def decline_codes(spark: SparkSession) -> DataFrame:
    return spark.sql(codes_sql())


def playbooks(spark: SparkSession) -> DataFrame:
    return spark.sql(playbooks_sql())


def named(spark: SparkSession, rows, key: str) -> DataFrame:
    return spark.sql(names_sql(rows, key))


def merchant_countries(spark: SparkSession) -> DataFrame:
    return spark.sql(values_sql([(m, c) for m, _, c in MERCHANTS], ("merchant_id", "country")))


def issuer_countries(spark: SparkSession) -> DataFrame:
    return spark.sql(values_sql([(i, c) for i, _, c in ISSUERS], ("issuer_id", "country")))
