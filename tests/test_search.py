import pytest
from pyspark.sql import functions as F

from dipwatch.constants import DIMS, FREE_DIMS, ROOT_DIMS
from dipwatch.operators.requests import residual_test
from dipwatch.operators.search import candidates, peel, residual
from tests.grids import NOON, br_dual, br_flat, br_full, br_two, frame, key, mx_issuer

BR = dict(country="BR", merchant_id="BR_STORE_01")
ADYEN_ITAU = key(**BR, provider_id="adyen", payment_method="CARD", issuer_id="itau")


def problems(rows, expected=0.9):
    return rows.select("bucket", "minute", *ROOT_DIMS).distinct().select(
        F.concat_ws("@", "merchant_id", F.col("minute").cast("string")).alias("pid"), "bucket", "minute",
        F.lit(expected).alias("root_expected"), F.lit(3.0).alias("delta_pp"), *ROOT_DIMS,
        *[F.lit(None).cast("string").alias(d) for d in FREE_DIMS],
    )


def test_residual_with_and_without_the_cause(spark):
    r = frame(spark, [x for x in br_full() if x[4] == "CARD"])
    p = problems(r)
    none = p.select("pid", *[F.lit(None).cast("string").alias(f"cell_{d}") for d in DIMS]).where("false")
    whole = residual(r, p, none).first()
    assert (whole.attempts, whole.approved, whole.state) == (1100, 790, "MATERIAL_DROP")
    assert whole.deficit == pytest.approx(200)
    cell = dict(merchant_id="BR_STORE_01", provider_id="adyen", country="BR", payment_method="CARD", issuer_id="itau")
    carved = p.select("pid", *[F.lit(cell[d]).alias(f"cell_{d}") for d in DIMS])
    left = residual(r, p, carved).first()
    assert (left.attempts, left.approved, left.deficit, left.state) == (800, 760, 0.0, "HEALTHY")


def test_causal_cell_of_the_full_grid(spark, coverage):
    r = frame(spark, br_full())
    best = candidates(r, problems(r), coverage).where("causal").first()
    assert (best.key, best.depth, best.n, best.k) == (ADYEN_ITAU, 3, 300, 30)
    assert best.expected == pytest.approx(0.95) and best.explained == pytest.approx(182)


def test_peel_finds_both_causes_and_echoes(spark, coverage):
    r = frame(spark, br_two())
    causes, _ = peel(r, problems(r), coverage)
    got = [(x.peel_no, x.key) for x in causes.orderBy("peel_no").collect()]
    assert got == [(1, ADYEN_ITAU), (2, key(**BR, provider_id="stripe", payment_method="CARD", issuer_id="nubank"))]
    r = frame(spark, br_full())
    _, echoes = peel(r, problems(r), coverage)
    echo = echoes.where(F.col("key") == key(**BR, provider_id="adyen")).first()
    assert echo.observed == pytest.approx(316 / 600) and echo.residual_rate == pytest.approx(286 / 300)


def test_flat_drop_has_no_cause(spark, coverage):
    r = frame(spark, br_flat())
    causes, echoes = peel(r, problems(r), coverage)
    assert causes.count() == 0 and echoes.count() == 0


def test_many_problems_at_once(spark, coverage):
    r = frame(spark, br_two(NOON) + br_flat(NOON + 1) + br_full(NOON + 2) + mx_issuer(NOON) + br_dual(NOON + 3))
    causes, _ = peel(r, problems(r), coverage)
    got = {(x.pid, x.peel_no): x.key for x in causes.collect()}
    assert got == {
        (f"BR_STORE_01@{NOON}", 1): ADYEN_ITAU,
        (f"BR_STORE_01@{NOON}", 2): key(**BR, provider_id="stripe", payment_method="CARD", issuer_id="nubank"),
        (f"BR_STORE_01@{NOON + 2}", 1): ADYEN_ITAU,
        (f"MX_STORE_01@{NOON}", 1): key(country="MX", merchant_id="MX_STORE_01", issuer_id="bbva_mx"),
        (f"BR_STORE_01@{NOON + 3}", 1): key(**BR, provider_id="stripe", payment_method="CARD", issuer_id="itau"),
    }


def test_residual_verdicts(spark, coverage, merchants):
    r = frame(spark, mx_issuer() + br_full())
    asked = [("cause", "MX", "MX_STORE_01", "issuer_id", "bbva_mx"), ("echo", "MX", "MX_STORE_01", "provider_id", "adyen")]
    req = spark.createDataFrame([(i, NOON, m, None, c, None, None, d, v) for i, c, m, d, v in asked],
                                "request_id string, minute bigint, merchant_id string, provider_id string, country string,"
                                " payment_method string, issuer_id string, candidate_dim string, candidate_value string")
    req = req.join(r.select("minute", "bucket").distinct(), "minute")
    got = {x.request_id: x for x in residual_test(r, req, merchants, coverage).collect()}
    assert got["cause"].verdict == "ROOT_CAUSE" and got["cause"].residual_delta_pp == pytest.approx((570 / 600 - 690 / 900) * 100)
    assert got["echo"].verdict == "ECHO" and got["echo"].explained_deficit == 0
