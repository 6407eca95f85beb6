"""Checks over narratives and investigation steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipwatch.operators.report import fixed

NUMBER = r"-?\d+(?:\.\d+)?"
REQUIRED_TOOLS = ("run_residual_test", "scan_incident_onset", "estimate_incident_impact")
RUN_STATUS = ("running", "completed", "failed", "timed_out", "exhausted")


def numbers_in(text: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(f"({NUMBER})"), F.lit(1))


def narrative_numbers(narratives: DataFrame) -> DataFrame:
    """Distinct (id, number) pairs; the distinct is partial on every map task."""
    return narratives.select("id", F.explode(numbers_in("text")).alias("number")).distinct()


def _plain(value: Column) -> Column:
    """A double the way a person writes it: shortest digits, no trailing zeros, no exponent."""
    digits = F.regexp_replace(F.regexp_replace(F.format_string("%.12f", value), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    short = F.regexp_replace(value.cast("string"), r"\.0$", "")
    return F.when((F.abs(value) >= 1e-3) & (F.abs(value) < 1e7), short).otherwise(digits)


def spoken_forms(number: Column) -> Column:
    """Texts under which a measured value may be quoted; rates also as percentages."""
    percent = number * 100
    forms = F.array(_plain(number))
    more = F.array(_plain(percent), F.round(percent).cast("bigint").cast("string"), fixed(percent))
    return F.when((number >= 0) & (number <= 1), F.concat(forms, more)).otherwise(forms)


def allowed_from_json(evidence: DataFrame) -> DataFrame:
    """Numbers a narrative may use, from each evidence object (``id``, ``evidence`` JSON).

    Values count in all their spoken forms, numbers inside strings only as
    written, object keys not at all.
    """
    values = F.regexp_replace("evidence", r'"(?:[^"\\]|\\.)*"\s*:', ":")
    bare = F.regexp_replace(values, r'"(?:[^"\\]|\\.)*"', "")
    measured = F.flatten(F.transform(
        F.regexp_extract_all(bare, F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"), F.lit(1)),
        lambda t: spoken_forms(t.cast("double")),
    ))
    quoted = F.flatten(F.transform(
        F.regexp_extract_all(values, F.lit(r'("(?:[^"\\]|\\.)*")'), F.lit(1)),
        lambda t: F.regexp_extract_all(t, F.lit(f"({NUMBER})"), F.lit(1)),
    ))
    return evidence.select("id", F.explode(F.concat(measured, quoted)).alias("number")).distinct()


def ungrounded_numbers(narratives: DataFrame, allowed: DataFrame) -> DataFrame:
    """Numbers a narrative prints that its evidence does not hold."""
    return narrative_numbers(narratives).join(allowed.select("id", "number"), ["id", "number"], "left_anti")


def bad_references(steps: DataFrame) -> DataFrame:
    """Citations of a step that is later than the citing one or was not completed."""
    cited = steps.select("run_id", "step_no", F.explode("evidence_step_nos").alias("ref"))
    done = steps.where(F.col("status") == "completed").select("run_id", F.col("step_no").alias("ref"), F.lit(True).alias("done"))
    checked = cited.join(done, ["run_id", "ref"], "left")
    reason = F.when(F.col("ref") >= F.col("step_no"), "future_step").when(F.col("done").isNull(), "unavailable_step")
    return checked.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("run_id", "step_no", "ref", "reason")


def unsupported_conclusions(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Conclusions whose supporting steps are missing or incomplete, or that skipped a required tool."""
    support = runs.select("run_id", F.explode("supporting_step_nos").alias("step_no"))
    states = steps.select("run_id", "step_no", F.col("status").alias("step_status"))
    weak = support.join(states, ["run_id", "step_no"], "left").where(
        F.col("step_status").isNull() | (F.col("step_status") != "completed")
    ).select(
        "run_id", F.when(F.col("step_status").isNull(), "missing_step").otherwise("incomplete_step").alias("reason"),
        F.col("step_no").cast("string").alias("detail"),
    )
    used = steps.where((F.col("status") == "completed") & F.col("tool_name").isin(*REQUIRED_TOOLS)).groupBy("run_id").agg(
        F.collect_set("tool_name").alias("used")
    )
    required = F.array(*map(F.lit, REQUIRED_TOOLS))
    lacking = runs.where(F.col("conclusion") == "CONCLUSIVE").join(used, "run_id", "left").select(
        "run_id", F.lit("missing_tool").alias("reason"),
        F.explode(F.array_except(required, F.coalesce("used", F.array().cast("array<string>")))).alias("detail"),
    )
    return weak.unionByName(lacking)


def orphan_runs(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == "running")


def inconsistent_steps(steps: DataFrame) -> DataFrame:
    """Completed steps need a result and no error, failed ones an error; other states are unknown."""
    completed = F.col("status") == "completed"
    failed = F.col("status") == "failed"
    reason = (
        F.when(~completed & ~failed, "unknown_status")
        .when(completed & F.col("tool_result").isNull(), "completed_without_result")
        .when(completed & F.col("error_code").isNotNull(), "completed_with_error")
        .when(failed & F.col("error_code").isNull(), "failed_without_error")
    )
    return steps.withColumn("reason", reason).where(F.col("reason").isNotNull())


def runs_of(runs: DataFrame, incident_ids: DataFrame) -> DataFrame:
    return runs.join(incident_ids, "incident_id", "left_semi").orderBy("incident_id", F.desc("started_at"), "run_id")
