"""Detection readings: three lenses, the family-wise z, one reading per slice and minute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from dipwatch.constants import DIMS, HISTORY_MIN, MIN_VOLUME, ROOT_DIMS, THIN_CELL_WINDOW_MIN
from dipwatch.functions.cells import cell_key
from dipwatch.functions.minutes import with_trailing
from dipwatch.functions.stats import DROP, THIN, family_z, rate, with_verdict
from dipwatch.operators.slices import slice_sums

COMMON = ["bucket", "minute", "split", *DIMS, "delta_pp"]


def hypotheses(rollup: DataFrame, merchants: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row per slice and minute with the expected rate of each lens that tests it.

    ``expected_absolute`` is set on roots, ``expected_cross`` and
    ``expected_temporal`` on their children; null means the lens does not test
    the slice. Each non-null value is one hypothesis of its minute.
    """
    slices = slice_sums(rollup)

    # Reference of the siblings: the parent without the child. Uncovered
    # siblings count here, coverage only limits which children are tested.
    parent = Window.partitionBy("bucket", *ROOT_DIMS, "split")
    sib_n = F.sum("attempts").over(parent) - F.col("attempts")
    sib_k = F.sum("approved").over(parent) - F.col("approved")
    slices = slices.withColumn("sibling_rate", rate(sib_k, sib_n))

    covered_providers = coverage.select("country", F.col("provider_id").alias("covered_value")).distinct()
    covered_methods = coverage.select("country", F.col("payment_method").alias("covered_value")).distinct()
    known = covered_providers.withColumn("split", F.lit("provider")).unionByName(
        covered_methods.withColumn("split", F.lit("method"))
    ).withColumn("is_covered", F.lit(True))
    value = F.when(F.col("split") == "provider", F.col("provider_id")).when(
        F.col("split") == "method", F.col("payment_method")
    )
    slices = (
        slices.withColumn("covered_value", value)
        .join(known, ["country", "split", "covered_value"], "left")
        .withColumn("is_covered", F.coalesce("is_covered", F.col("split") == "issuer"))
        .withColumn("covered_siblings", F.count(F.when(F.col("is_covered"), 1)).over(parent))
    )

    # The slice's own past and the widened window for thin drops.
    slices = with_trailing(
        slices,
        ["split", *DIMS],
        HISTORY_MIN,
        {
            "past_n": (F.sum("attempts"), HISTORY_MIN, 1),
            "past_k": (F.sum("approved"), HISTORY_MIN, 1),
            "wide_n": (F.sum("attempts"), THIN_CELL_WINDOW_MIN - 1, 0),
            "wide_k": (F.sum("approved"), THIN_CELL_WINDOW_MIN - 1, 0),
        },
    )

    configured = slices.join(merchants, "merchant_id", "inner")
    root = F.col("split") == "root"
    tested = ~root & F.col("is_covered")
    enough_past = F.coalesce(F.col("past_n"), F.lit(0)) >= MIN_VOLUME
    wide = configured.select(
        *COMMON,
        "attempts",
        "approved",
        "wide_n",
        "wide_k",
        F.when(root, F.col("expected_conversion")).alias("expected_absolute"),
        F.when(tested & (F.col("covered_siblings") >= 2), F.col("sibling_rate")).alias("expected_cross"),
        F.when(tested & enough_past, rate(F.col("past_k"), F.col("past_n"))).alias("expected_temporal"),
    )
    lenses = F.coalesce("expected_absolute", "expected_cross", "expected_temporal")
    return wide.where(lenses.isNotNull())


def families(hypotheses: DataFrame) -> DataFrame:
    """Number of hypotheses per minute, every lens counted, and the z it asks for.

    Partial aggregation reduces each map task to one row per minute before the
    shuffle; a window over the minute would move every slice of it to one task.
    """
    lenses = [F.count(c) for c in ("expected_absolute", "expected_cross", "expected_temporal")]
    return hypotheses.groupBy("bucket").agg((lenses[0] + lenses[1] + lenses[2]).alias("m")).withColumn(
        "z", family_z(F.col("m"))
    )


def readings(hypotheses: DataFrame, families: DataFrame) -> DataFrame:
    """One verdict per slice and minute under the family-wise z.

    ``kind`` tells what became of it: ``reading`` counts for persistence,
    ``gap`` is a slice without enough evidence.
    """
    one = hypotheses.join(families.select("bucket", "z"), "bucket", "inner")
    for lens in ("cross", "temporal"):
        one = with_verdict(one, "approved", "attempts", f"expected_{lens}", "delta_pp", "z", f"{lens}_")
    source = (
        F.when(F.col("expected_absolute").isNotNull(), "absolute")
        .when(F.col("expected_cross").isNull(), "temporal")
        .when(F.col("expected_temporal").isNull(), "cross_sectional")
        .when((F.col("cross_state") == DROP) | (F.col("cross_state") == F.col("temporal_state")), "cross_sectional")
        .otherwise("temporal")
    )
    one = one.withColumn("expected_source", source).withColumn(
        "expected",
        F.when(F.col("expected_source") == "absolute", F.col("expected_absolute"))
        .when(F.col("expected_source") == "cross_sectional", F.col("expected_cross"))
        .otherwise(F.col("expected_temporal")),
    )
    one = with_verdict(one, "approved", "attempts", "expected", "delta_pp", "z", "plain_")
    # A thin drop is measured again over five minutes, same reference, same z.
    one = with_verdict(one, "wide_k", "wide_n", "expected", "delta_pp", "z", "wide_")
    retried = (F.col("plain_state") == DROP) & (F.col("attempts") < MIN_VOLUME)
    rescued = retried & (F.col("wide_state") == DROP) & (F.col("wide_n") >= MIN_VOLUME)
    gap = (F.col("plain_state") == THIN) | (retried & ~rescued)

    def wide(widened, plain):
        return F.when(rescued, F.col(widened)).otherwise(F.col(plain))

    return one.select(
        *COMMON,
        cell_key().alias("cell_key"),
        "z",
        "expected_source",
        "expected",
        F.when(gap, "gap").otherwise("reading").alias("kind"),
        F.when(gap, THIN).otherwise(F.col("plain_state")).alias("state"),
        F.when(retried, F.col("wide_n")).otherwise(F.col("attempts")).alias("attempts"),
        F.when(retried, F.col("wide_k")).otherwise(F.col("approved")).alias("approved"),
        wide("wide_ci_low", "plain_ci_low").alias("ci_low"),
        wide("wide_ci_high", "plain_ci_high").alias("ci_high"),
        F.when(rescued, "5m").otherwise("1m").alias("window_used"),
    )


def confident(all_readings: DataFrame) -> DataFrame:
    return all_readings.where(F.col("kind") == "reading").withColumn(
        "observed", F.coalesce(rate(F.col("approved"), F.col("attempts")), F.lit(0.0))
    )


def gaps(all_readings: DataFrame) -> DataFrame:
    """Slices without enough evidence. One row per (bucket, cell) by construction."""
    return all_readings.where(F.col("kind") == "gap").select(
        "bucket", "minute", *DIMS, "cell_key", "attempts", F.lit(THIN).alias("reason")
    )
