"""Rates, Wilson intervals, verdicts and the family-wise z, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipwatch.constants import FAMILY_ALPHA, MIN_VOLUME, Z

DROP = "MATERIAL_DROP"
HEALTHY = "HEALTHY"
THIN = "INSUFFICIENT_EVIDENCE"
MONITORING = "MONITORING"


def rate(k: Column, n: Column) -> Column:
    """Conversion rate; null when nothing was attempted."""
    return F.try_divide(k.cast("double"), n.cast("double"))


def wilson_sql(k: str, n: str, z: str) -> tuple[str, str]:
    """Bounds of the Wilson score interval as SQL text, (0, 1) for an empty sample.

    Written with one division by n, which keeps the generated code of the
    many places that use it small.
    """
    middle = f"{k} + {z} * {z} / 2D"
    half = f"{z} * sqrt(double({k}) * ({n} - {k}) / {n} + {z} * {z} / 4D)"
    low = f"CASE WHEN {n} = 0 THEN 0D ELSE greatest(0D, ({middle} - {half}) / ({n} + {z} * {z})) END"
    high = f"CASE WHEN {n} = 0 THEN 1D ELSE least(1D, ({middle} + {half}) / ({n} + {z} * {z})) END"
    return low, high


def wilson(k: str, n: str, z: str | float = Z) -> tuple[Column, Column]:
    low, high = wilson_sql(k, n, f"{z}D" if isinstance(z, float) else z)
    return F.expr(low), F.expr(high)


def with_verdict(df: DataFrame, k: str, n: str, expected: str, delta_pp: str, z: str | float = Z,
                 prefix: str = "") -> DataFrame:
    """Add ``<prefix>ci_low``, ``<prefix>ci_high`` and ``<prefix>state``.

    ``k``, ``n``, ``expected``, ``delta_pp`` and ``z`` are column names (or a
    number for z). Rows without an expected rate get nulls: that hypothesis
    does not exist. Volume is looked at only when the interval straddles the
    limit, so a thin slice can be a drop or healthy.
    """
    lower, upper = wilson_sql(k, n, f"{z}D" if isinstance(z, float) else z)
    limit = f"({expected} - {delta_pp} / 100)"
    low, high, state = f"{prefix}ci_low", f"{prefix}ci_high", f"{prefix}state"
    bounds = df.withColumns({
        low: F.expr(f"CASE WHEN {expected} IS NOT NULL THEN {lower} END"),
        high: F.expr(f"CASE WHEN {expected} IS NOT NULL THEN {upper} END"),
    })
    return bounds.withColumn(
        state,
        F.expr(
            f"CASE WHEN {expected} IS NULL THEN NULL WHEN {high} < {limit} THEN '{DROP}'"
            f" WHEN {low} > {limit} THEN '{HEALTHY}' WHEN {n} < {MIN_VOLUME} THEN '{THIN}' ELSE '{MONITORING}' END"
        ),
    )


# Coefficients of Acklam's published rational approximation of the inverse
# normal distribution; fixed values, highest power first.
ACKLAM_CENTER_NUM = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2,
                     1.38357751867269e2, -3.066479806614716e1, 2.506628277459239)
ACKLAM_CENTER_DEN = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2,
                     6.680131188771972e1, -1.328068155288572e1, 1.0)
ACKLAM_TAIL_NUM = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838,
                   -2.549732539343734, 4.374664141464968, 2.938163982698783)
ACKLAM_TAIL_DEN = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996,
                   3.754408661907416, 1.0)
ACKLAM_TAIL_FROM = 0.02425


def _horner(coefficients, x: Column) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def inverse_normal(p: Column) -> Column:
    def tail(q: Column) -> Column:
        return _horner(ACKLAM_TAIL_NUM, q) / _horner(ACKLAM_TAIL_DEN, q)

    q = p - F.lit(0.5)
    center = _horner(ACKLAM_CENTER_NUM, q * q) * q / _horner(ACKLAM_CENTER_DEN, q * q)
    return (
        F.when(p < ACKLAM_TAIL_FROM, tail(F.sqrt(F.lit(-2.0) * F.ln(p))))
        .when(p <= 1 - ACKLAM_TAIL_FROM, center)
        .otherwise(-tail(F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - p))))
    )


def family_z(hypotheses: Column) -> Column:
    """Two-sided z holding the family error at alpha over that many tests."""
    m = hypotheses.cast("double")
    per_test = F.lit(1.0) - F.pow(F.lit(1.0 - FAMILY_ALPHA), F.lit(1.0) / m)
    usable = m.isNotNull() & ~F.isnan(m) & (m >= 1) & (m < F.lit(float("inf")))
    return F.when(usable, inverse_normal(F.lit(1.0) - per_test / F.lit(2.0))).otherwise(F.lit(Z))
