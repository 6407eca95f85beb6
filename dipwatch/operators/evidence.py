"""Evidence objects and investigation trails, assembled from diagnoses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from dipwatch.constants import DIMS, FREE_DIMS, ROOT_DIMS
from dipwatch.functions.cells import cell_key, cell_struct
from dipwatch.functions.stats import rate


def evidence(diagnoses: DataFrame, source: str = "beam_search") -> DataFrame:
    """One evidence row per diagnosis: rounded costs, nested mix and echoes, fingerprint.

    An echo whose slice the cause swallowed whole has no residual rate and does
    not travel.
    """
    mix = F.transform(
        "shifts",
        lambda s: F.struct(s["code"], s["family"], s["observed_share"], s["reference_share"].alias("baseline_share"), s["count"]),
    )
    key = cell_key()
    return diagnoses.select(
        "request_id", "bucket", "minute", *DIMS,
        F.concat(key, F.coalesce(F.concat(F.lit("#"), F.col("dominant_code")), F.lit(""))).alias("fingerprint"),
        key.alias("cell_key"), cell_struct().alias("dimensions"),
        "observed_rate", "expected_rate", "expected_source", "delta_pp",
        F.struct(F.col("ci_low").alias("low"), F.col("ci_high").alias("high"), F.lit(0.95).alias("level")).alias("ci"),
        "attempts", "approved", "window_used", "consecutive_windows", "started_at", "started_at_exact",
        F.coalesce(mix, F.array().cast(
            "array<struct<code:string,family:string,observed_share:double,baseline_share:double,count:bigint>>"
        )).alias("decline_mix"),
        F.col("dominant_code").alias("dominant_decline"), "dominant_family",
        F.filter("echoes", lambda e: e["residual_rate"].isNotNull()).alias("suppressed_echoes"),
        "lost_approvals", F.round("cost_usd_minor").cast("bigint").alias("cost_usd_minor"),
        F.round("cost_usd_per_min").cast("bigint").alias("cost_usd_per_min"), "cost_local", "priority_score",
        F.lit(source).alias("diagnosis_source"), "confidence", "causal_dimension",
    )


def evidence_json(rows: DataFrame) -> DataFrame:
    """The whole evidence object as one JSON text per row."""
    fields = [c for c in rows.columns if c not in ("request_id", "minute", *DIMS)]
    return rows.select("request_id", F.to_json(F.struct(*fields)).alias("evidence"))


def sibling_rates(rollup: DataFrame, parents: DataFrame) -> DataFrame:
    """Rate of every value that each parent's next dimension takes, as a map.

    ``parents``: step_id, bucket, the parent cell, and ``axis`` naming the split
    dimension. Values come from all rows of the parent, covered or not.
    """
    value = F.coalesce(*[F.when(F.col("axis") == d, F.col(f"row_{d}")) for d in FREE_DIMS])
    rows = rollup.select(
        F.col("bucket").alias("row_bucket"), *[F.col(d).alias(f"row_{d}") for d in DIMS], "attempts", "approved"
    )
    on = [F.col("bucket") == F.col("row_bucket")] + [F.col(d) == F.col(f"row_{d}") for d in ROOT_DIMS]
    inside = [F.col(d).isNull() | (F.col(d) == F.col(f"row_{d}")) for d in FREE_DIMS]
    summed = parents.join(rows, on + inside, "inner").groupBy("step_id", value.alias("value")).agg(
        F.sum("attempts").alias("n"), F.sum("approved").alias("k")
    )
    return summed.groupBy("step_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct("value", F.coalesce(rate(F.col("k"), F.col("n")), F.lit(0.0)).alias("rate"))
        ))).alias("rates")
    )


def trail(diagnoses: DataFrame, rollup: DataFrame) -> DataFrame:
    """Investigation steps of each diagnosis, numbered, each citing the one before.

    The walk fixes the cell's dimensions in search order; a diagnosis that
    fixed none walks all three to show its siblings level.
    """
    fixed = [F.when(F.col(d).isNotNull(), F.lit(d)) for d in FREE_DIMS]
    walked = F.array_compact(F.array(*fixed))
    none_fixed = F.size(walked) == 0
    axes = F.when(none_fixed, F.array(*map(F.lit, FREE_DIMS))).otherwise(walked)
    steps = diagnoses.select(
        "request_id", "bucket", *DIMS, "explained_deficit", "dominant_code", "mix_window_min", "total_declines",
        none_fixed.alias("open_walk"), F.posexplode(axes).alias("at", "axis"),
    )
    # The parent of a step holds only the dimensions fixed before it.
    order = {d: i for i, d in enumerate(FREE_DIMS)}
    rank = F.coalesce(*[F.when(F.col("axis") == d, F.lit(i)) for d, i in order.items()])
    parents = steps.select(
        F.concat_ws("/", "request_id", F.col("at").cast("string")).alias("step_id"), "bucket", "axis", *ROOT_DIMS,
        *[F.when(~F.col("open_walk") & (rank > order[d]), F.col(d)).alias(d) for d in FREE_DIMS],
    )
    value = F.coalesce(*[F.when(F.col("axis") == d, F.col(d)) for d in FREE_DIMS])
    # Tool names, tags and summaries below are fixed wording.
    drill = steps.withColumn("step_id", F.concat_ws("/", "request_id", F.col("at").cast("string"))).join(
        sibling_rates(rollup, parents), "step_id", "inner"
    ).select(
        "request_id", F.col("at").alias("seq"), F.lit("query_conversion_slice").alias("tool_name"),
        F.lit("DRILL_DOWN").alias("decision_tag"), "axis", value.alias("fixed_value"), "rates",
        F.when(value.isNull(), F.concat(F.lit("Compared siblings for "), "axis", F.lit(" under the current root.")))
        .otherwise(F.concat(F.lit("Fixed "), "axis", F.lit("="), value, F.lit(" after comparing sibling conversion rates.")))
        .alias("decision_summary"),
    )
    empty = F.lit(None).cast("map<string,double>")
    check = diagnoses.select(
        "request_id", F.lit(10).alias("seq"), F.lit("run_residual_test").alias("tool_name"),
        F.lit("VALIDATE_RESIDUAL").alias("decision_tag"), F.lit(None).cast("string").alias("axis"),
        F.lit(None).cast("string").alias("fixed_value"), empty.alias("rates"),
        F.lit("Validated that the selected cell explains the residual deficit.").alias("decision_summary"),
    )
    mix = diagnoses.where("total_declines IS NOT NULL").select(
        "request_id", F.lit(11).alias("seq"), F.lit("query_decline_mix").alias("tool_name"),
        F.lit("CHECK_DECLINE_MIX").alias("decision_tag"), F.lit(None).cast("string").alias("axis"),
        F.lit(None).cast("string").alias("fixed_value"), empty.alias("rates"),
        F.lit("Checked the decline-code mix shift for diagnostic evidence.").alias("decision_summary"),
    )
    order_by = Window.partitionBy("request_id").orderBy("seq")
    numbered = drill.unionByName(check).unionByName(mix).withColumn("step_no", F.row_number().over(order_by))
    before = F.lag("step_no").over(order_by)
    return numbered.withColumn(
        "evidence_step_nos", F.when(before.isNull(), F.array().cast("array<int>")).otherwise(F.array(before))
    ).withColumns({"status": F.lit("completed"), "error_code": F.lit(None).cast("string")}).drop("seq")
