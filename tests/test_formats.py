"""Number texts, markers and slices without a country."""

from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from dipwatch.functions.minutes import calendar
from dipwatch.operators.report import fixed, percent
from dipwatch.operators.requests import conversion_slice, incident_impact
from dipwatch.operators.series import marker_buckets
from tests.grids import NOON, frame, row


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_half_way_texts_follow_the_exact_value(spark, digits):
    values = [i / 1000 for i in range(-300, 12_500, 7)] + [i / 16 for i in range(200)] + [12.45, 0.05, 0.15, 2.5, 1e6 + 0.05, 99999.95, 0.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed(F.col("v"), digits).alias("t")).collect()
    for r in rows:
        want = abs(Decimal(r.v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)
        assert r.t == ("-" if r.v < 0 else "") + str(want)


def test_percent_of_a_value_a_little_below_the_half(spark):
    assert spark.createDataFrame([(0.1245,)], "v double").select(percent(F.col("v"))).first()[0] == "12.4%"


def test_marker_before_days_without_traffic(spark):
    days = calendar(spark.createDataFrame([(m,) for m in (NOON, NOON + 1, NOON + 5000, NOON + 5001)], "minute bigint"))
    markers = spark.createDataFrame([("a", NOON + 1), ("b", NOON + 2), ("c", NOON + 1500), ("d", NOON + 6000), ("e", NOON - 9000)],
                                    "marker_id string, starts_minute bigint")
    got = {r.marker_id: r.minute - NOON for r in marker_buckets(markers, days, F.lit(NOON + 5001)).collect()}
    assert got == {"a": 1, "b": 5000, "c": 5000, "d": 5001, "e": 0}


def test_slice_without_a_country(spark, merchants):
    rollup = frame(spark, [row(50, 10, "stripe", "itau", NOON), row(50, 10, "stripe", "nubank", NOON), row(70, 70, "adyen", "itau", NOON)])
    asked = spark.createDataFrame([("r", NOON, "BR_STORE_01", "stripe", None, None, None, NOON, 0.9)],
                                  "request_id string, minute bigint, merchant_id string, provider_id string, country string, payment_method string,"
                                  " issuer_id string, started_minute bigint, expected double").withColumn("bucket", F.timestamp_seconds(F.col("minute") * 60))
    found = conversion_slice(rollup, asked.drop("expected"), merchants).first()
    assert (found.attempts, found.approved) == (100, 20)
    assert incident_impact(rollup, asked).first().lost_approvals > 0
