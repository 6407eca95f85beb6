import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from dipwatch.functions.cells import cell_key, compatible, inside_but_not, same_cell, specificity
from dipwatch.functions.stats import family_z, wilson, with_verdict


def textbook(k, n, z):
    if n == 0:
        return 0.0, 1.0
    p = k / n
    mid, spread = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return max(0.0, (mid - spread) / (1 + z * z / n)), min(1.0, (mid + spread) / (1 + z * z / n))


def test_wilson_matches_the_textbook_formula(spark):
    cases = [(k, n) for n in (0, 1, 2, 5, 30, 91, 1000) for k in {0, n // 3, n // 2, n}]
    df = spark.createDataFrame(cases, "k bigint, n bigint")
    low, high = wilson("k", "n")
    for r in df.select("k", "n", low.alias("low"), high.alias("high")).collect():
        assert (r.low, r.high) == pytest.approx(textbook(r.k, r.n, 1.96), abs=1e-12)
    assert textbook(2, 5, 1.96)[0] == pytest.approx(0.1176, abs=1e-4)


@pytest.mark.parametrize("k, n, state", [
    (9, 30, "MATERIAL_DROP"), (28, 30, "HEALTHY"), (4, 6, "INSUFFICIENT_EVIDENCE"), (20, 30, "MONITORING"),
])
def test_states(spark, k, n, state):
    df = spark.createDataFrame([(k, n, 0.7, 3.0)], "k bigint, n bigint, e double, d double")
    assert with_verdict(df, "k", "n", "e", "d").first()["state"] == state


def test_family_z(spark):
    df = spark.createDataFrame([(-3,), (0,), (1,), (2,), (69,), (129,), (50_000,)], "m bigint")
    got = {r.m: r.z for r in df.select("m", family_z(F.col("m")).alias("z")).collect()}
    assert got[-3] == got[0] == 1.96
    assert got[1] == pytest.approx(1.96, abs=1e-3)
    assert got[69] == pytest.approx(3.37, abs=5e-3)
    for m in (1, 2, 69, 129, 50_000):
        per_test = 1 - 0.95 ** (1 / m)
        assert got[m] == pytest.approx(NormalDist().inv_cdf(1 - per_test / 2), abs=1e-6)


def test_corrected_z_changes_verdicts(spark):
    rows = [("noise", 79, 91, 0.973), ("fault", 4, 45, 0.9), ("fine", 950, 1000, 0.9)]
    df = spark.createDataFrame(rows, "name string, k bigint, n bigint, e double").withColumn("d", F.lit(3.0))
    df = df.withColumn("z", family_z(F.lit(69)))
    one = {r.name: r.state for r in with_verdict(df, "k", "n", "e", "d").collect()}
    many = {r.name: r.state for r in with_verdict(df, "k", "n", "e", "d", "z").collect()}
    assert one["noise"] == "MATERIAL_DROP" and many["noise"] != "MATERIAL_DROP"
    assert many["fault"] == "MATERIAL_DROP" and many["fine"] == "HEALTHY"


def test_cells(spark):
    schema = ", ".join(f"{p}{d} string" for p in ("", "cell_", "other_")
                       for d in ("merchant_id", "provider_id", "country", "payment_method", "issuer_id"))
    row = ("M", "stripe", "BR", "CARD", "itau")
    cell = ("M", "stripe", "BR", None, None)
    df = spark.createDataFrame([
        (*row, *cell, "M", None, "BR", None, "itau"),
        (*row, *cell, "M", "adyen", "BR", None, None),
        (*row, *cell, None, None, None, None, None),
    ], schema)
    got = df.select(
        cell_key("cell_").alias("key"), compatible("cell_", "other_").alias("fits"), same_cell("cell_", "other_").alias("same"),
        specificity("other_").alias("fixed"), inside_but_not("cell_", "other_").alias("left"),
    ).collect()
    assert got[0].key == "country=BR|merchantId=M|providerId=stripe"
    assert [r.fits for r in got] == [True, False, True]
    assert [r.fixed for r in got] == [3, 3, 0]
    assert not any(r.same for r in got)
    # An empty excluded cell matches everything.
    assert [r.left for r in got] == [False, True, False]


def test_slice_sums_with_a_cell_left_out(spark):
    from dipwatch.constants import DIMS
    from dipwatch.operators.slices import slice_totals
    from tests.grids import frame, row
    rows = frame(spark, [row(100, 30, "adyen"), row(100, 90, "stripe"), row(100, 95, "mercado_pago")])
    root = rows.select("bucket").distinct().withColumns({f"cell_{d}": F.lit(None).cast("string") for d in DIMS})
    whole = slice_totals(rows, root, ["bucket"]).first()
    assert (whole.attempts, whole.approved) == (300, 215)
    without = root.withColumns({f"excluded_{d}": F.lit("adyen" if d == "provider_id" else None).cast("string") for d in DIMS})
    assert slice_totals(rows, without, ["bucket"]).first().rate == pytest.approx(0.925)
    nothing = root.withColumns({f"excluded_{d}": F.lit(None).cast("string") for d in DIMS})
    assert slice_totals(rows, nothing, ["bucket"]).first().attempts == 0
