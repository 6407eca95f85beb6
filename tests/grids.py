"""Small literal inputs with known answers."""

from __future__ import annotations

from dipwatch.constants import DIMS

NOON = 29801646  # 2026-08-30 14:06 UTC in epoch minutes
PROVIDERS = ("stripe", "adyen", "mercado_pago")
ROLLUP = (
    "minute bigint, merchant_id string, provider_id string, country string, payment_method string, issuer_id string,"
    " attempts bigint, approved bigint, amount_minor_sum bigint, amount_usd_sum bigint, approved_usd_sum bigint"
)
DECLINES = (
    "minute bigint, merchant_id string, provider_id string, country string, payment_method string, issuer_id string,"
    " decline_code string, declines bigint"
)


def row(n, k, provider="adyen", issuer="itau", minute=NOON, merchant="BR_STORE_01", country="BR", method="CARD",
        local=50_000, usd=10_000):
    return (minute, merchant, provider, country, method, issuer, n, k, n * local, n * usd, k * usd)


def frame(spark, rows, schema=ROLLUP):
    from dipwatch.functions.minutes import bucket_of
    return spark.createDataFrame(rows, schema).withColumn("bucket", bucket_of("minute"))


def br_card(special, n=100, k=95, minute=NOON):
    issuers = ("itau", "nubank", "bradesco")
    return [row(*special.get((p, i), (n, k)), p, i, minute) for p in PROVIDERS for i in issuers]


def pix(n, k, minute=NOON):
    return [row(n, k, p, "NA", minute, method="PIX") for p in PROVIDERS]


def br_full(minute=NOON):
    return br_card({("adyen", "itau"): (300, 30)}, minute=minute) + pix(100, 96, minute)


def br_two(minute=NOON):
    return br_card({("adyen", "itau"): (300, 30), ("stripe", "nubank"): (200, 20)}, minute=minute) + pix(100, 96, minute)


def br_flat(minute=NOON):
    return br_card({}, 40, 28, minute)


def br_dual(minute=NOON):
    return br_card({("stripe", "itau"): (76, 2), ("adyen", "nubank"): (76, 34)}, 76, 68, minute) + pix(228, 205, minute)


def mx_issuer(minute=NOON):
    return [
        row(100, 40 if i == "bbva_mx" else 95, p, i, minute, "MX_STORE_01", "MX", local=80_000, usd=4_000)
        for p in PROVIDERS for i in ("bbva_mx", "banorte", "citibanamex")
    ]


def key(**dims):
    names = {"country": "country", "issuerId": "issuer_id", "merchantId": "merchant_id", "paymentMethod": "payment_method",
             "providerId": "provider_id"}
    return "|".join(f"{n}={dims[d]}" for n, d in names.items() if dims.get(d))


def cell(**dims):
    return tuple(dims.get(d) for d in DIMS)
