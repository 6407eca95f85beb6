"""Detection slices and per-cell minute series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipwatch.constants import DIMS, FREE_DIMS, MEASURES
from dipwatch.functions.cells import inside_but_not, matches, project_to_masks
from dipwatch.functions.minutes import block_of, blocks_between
from dipwatch.functions.stats import rate


def slice_sums(rollup: DataFrame) -> DataFrame:
    """Every slice the detector tests, one row per (bucket, slice).

    Four grouping sets in one pass: the root, its providers, its card issuers
    and, where there is a choice of method, its methods. ``split`` names the
    set; card issuers carry ``payment_method`` CARD. The copies are summed on
    the map side before anything moves; the sibling windows that follow then
    shuffle only the sums.
    """
    tagged = rollup.withColumn(
        "split",
        F.explode(
            F.when(
                F.col("country") == "BR",
                F.when(F.col("payment_method") == "CARD", F.array(*map(F.lit, ("root", "provider", "issuer", "method"))))
                .otherwise(F.array(*map(F.lit, ("root", "provider", "method")))),
            ).otherwise(
                F.when(F.col("payment_method") == "CARD", F.array(*map(F.lit, ("root", "provider", "issuer"))))
                .otherwise(F.array(*map(F.lit, ("root", "provider"))))
            )
        ),
    )
    split = F.col("split")
    return (
        tagged.withColumn("provider_id", F.when(split == "provider", F.col("provider_id")))
        .withColumn("issuer_id", F.when(split == "issuer", F.col("issuer_id")))
        .withColumn("payment_method", F.when(split.isin("issuer", "method"), F.col("payment_method")))
        .groupBy("bucket", "minute", "split", *DIMS)
        .agg(F.sum("attempts").alias("attempts"), F.sum("approved").alias("approved"))
    )


def lattice_sums(rollup: DataFrame) -> DataFrame:
    """The search lattice: all provider x method x issuer slices under each root."""
    return project_to_masks(rollup).groupBy("bucket", "minute", "mask", *DIMS).agg(
        *[F.sum(m).alias(m) for m in MEASURES]
    )


def cell_series(rollup: DataFrame, cells: DataFrame, measures=MEASURES, extra: tuple[str, ...] = (),
                any_country: bool = False) -> DataFrame:
    """Minute series of the requested cells only.

    ``cells`` has the five dimension columns (merchant always set, country
    too unless ``any_country``) and a
    ``[from_minute, to_minute]`` range. Rows are cut down to the requested
    (cell, day) pairs by an equi semi-join on the masked key and then summed,
    so nothing is aggregated for a cell nobody asked about.
    """
    wanted = (
        cells.select(*DIMS, F.explode(blocks_between(F.col("from_minute"), F.col("to_minute"))).alias("block"))
        .distinct()
    )
    open_dims = ("country", *FREE_DIMS) if any_country else FREE_DIMS
    # First cut to the merchants and days asked about, then copy rows per mask.
    near = rollup.withColumn("block", block_of(F.col("minute"))).join(
        wanted.select("block", "merchant_id").distinct(), ["block", "merchant_id"], "left_semi"
    )
    keyed = project_to_masks(near, open_dims)
    left, right = keyed.alias("l"), wanted.alias("r")
    on = [F.col("l.block") == F.col("r.block")]
    on += [F.col(f"l.{d}") == F.col(f"r.{d}") for d in DIMS if d not in open_dims]
    on += [F.col(f"l.{d}").eqNullSafe(F.col(f"r.{d}")) for d in open_dims]
    # A free dimension nulled by the mask equals a wildcard, one kept by the
    # mask equals a fixed value: the mask itself needs no separate condition.
    kept = left.join(right, on, "left_semi")
    return kept.groupBy(*DIMS, "minute", *extra).agg(*[F.sum(m).alias(m) for m in measures])


def join_series(requests: DataFrame, series: DataFrame, value_columns: list[str]) -> DataFrame:
    """Attach the series rows inside each request's minute range (left join).

    The range is turned into day blocks on both sides so the join stays an
    equi-join; a row of the series falls into exactly one block.
    """
    asked = requests.withColumn("block", F.explode(blocks_between(F.col("from_minute"), F.col("to_minute"))))
    a = asked.alias("a")
    s = series.withColumn("block", block_of(F.col("minute"))).alias("s")
    on = [F.col("a.block") == F.col("s.block")]
    on += [F.col(f"a.{d}").eqNullSafe(F.col(f"s.{d}")) for d in DIMS]
    on += [F.col("s.minute").between(F.col("a.from_minute"), F.col("a.to_minute"))]
    return a.join(s, on, "left").select(
        *[F.col(f"a.{c}") for c in requests.columns],
        F.col("s.minute").alias("row_minute"),
        *[F.col(f"s.{c}").alias(f"row_{c}") for c in value_columns],
    )


def slice_totals(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Sums and rate of each requested cell among the rows sharing its ``keys``.

    Cells come as ``cell_*`` columns; with ``excluded_*`` columns present, rows
    of that second cell are left out (an all-null one leaves nothing).
    """
    open_dims = [d for d in DIMS if d not in keys]
    carved = any(c.startswith("excluded_") for c in cells.columns)
    inside = inside_but_not("cell_", "excluded_", "", open_dims) if carved else matches("cell_", "", open_dims)
    joined = cells.join(rows, keys, "left")
    sums = [F.coalesce(F.sum(F.when(inside, F.col(m))), F.lit(0).cast("bigint")).alias(m) for m in MEASURES]
    cell_columns = [c for c in cells.columns if c not in keys]
    return joined.groupBy(*keys, *cell_columns).agg(*sums).withColumn(
        "rate", rate(F.col("approved"), F.col("attempts"))
    )


def conversion_series(rollup: DataFrame, filters: dict[str, str], start: Column, end: Column) -> DataFrame:
    """Sums per bucket in ``[start, end)`` for one filter.

    Every bucket with traffic of any kind is reported; the filtered slice is
    zero where it had none. One aggregation does both, so no spine join.
    """
    in_range = rollup.where((F.col("bucket") >= start) & (F.col("bucket") < end))
    if "day" in rollup.columns:
        in_range = in_range.where(F.col("day").between(F.to_date(start), F.to_date(end)))
    inside = F.lit(True)
    for dim, value in filters.items():
        inside = inside & (F.col(dim) == value)
    zero = F.lit(0).cast("bigint")
    return in_range.groupBy("bucket").agg(
        F.sum(F.when(inside, F.col("attempts")).otherwise(zero)).alias("attempts"),
        F.sum(F.when(inside, F.col("approved")).otherwise(zero)).alias("approved"),
    ).withColumn("rate", rate(F.col("approved"), F.col("attempts")))
