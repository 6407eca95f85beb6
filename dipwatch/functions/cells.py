"""Cells: partial assignments of the five dimensions, NULL meaning "any"."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipwatch.constants import DIMS, FREE_DIMS, KEY_NAMES


def _col(prefix: str, dim: str) -> Column:
    return F.col(f"{prefix}{dim}")


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def matches(cell: str = "cell_", row: str = "", dims=DIMS) -> Column:
    """The row lies inside the cell; an all-null cell holds every row."""
    return _all([_col(cell, d).isNull() | (_col(row, d) == _col(cell, d)) for d in dims])


def inside_but_not(cell: str, excluded: str, row: str = "", dims=DIMS) -> Column:
    return matches(cell, row, dims) & ~F.coalesce(matches(excluded, row, dims), F.lit(False))


def compatible(left: str, right: str, dims=DIMS) -> Column:
    """The cells do not disagree on a dimension that both name."""
    return _all([
        _col(left, d).isNull() | _col(right, d).isNull() | (_col(left, d) == _col(right, d)) for d in dims
    ])


def same_cell(left: str, right: str, dims=DIMS) -> Column:
    return _all([_col(left, d).eqNullSafe(_col(right, d)) for d in dims])


def specificity(prefix: str = "", dims=DIMS) -> Column:
    return reduce(lambda a, b: a + b, [_col(prefix, d).isNotNull().cast("int") for d in dims])


def cell_key(prefix: str = "") -> Column:
    """``dim=value`` pairs of the fixed dimensions, joined in key order."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{name}="), _col(prefix, d)) for name, d in KEY_NAMES])


def cell_struct(prefix: str = "") -> Column:
    return F.struct(*[_col(prefix, d).alias(d) for d in DIMS])


def free_mask(prefix: str = "") -> Column:
    """Which of provider, method, issuer the cell fixes: bits 4, 2, 1."""
    return reduce(
        lambda a, b: a + b,
        [F.when(_col(prefix, d).isNotNull(), 4 >> i).otherwise(0) for i, d in enumerate(FREE_DIMS)],
    )


def project_to_masks(rows: DataFrame, dims=FREE_DIMS) -> DataFrame:
    """One copy of each row per subset of ``dims``, the others set to NULL.

    A wildcard match against partial cells then is a null-safe equi-join, so
    Spark never falls back to a nested loop.
    """
    top = len(dims) - 1
    exploded = rows.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(dims) - 1))))
    return exploded.withColumns({
        d: F.when(F.col("mask").bitwiseAND(1 << (top - i)) != 0, F.col(d)) for i, d in enumerate(dims)
    })
