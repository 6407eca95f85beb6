import pytest
from pyspark.sql import functions as F

from dipwatch.functions.minutes import minute_of
from dipwatch.operators.evidence import evidence
from dipwatch.operators.incidents import LOG_SCHEMA, incident_log
from dipwatch.operators.rollup import decline_rollup, minute_rollup
from dipwatch.plans.detect import detect
from dipwatch.plans.diagnose import diagnose
from dipwatch.session import stage, stage_path
from dipwatch.streaming.ingest import PAYMENT_ORDER, Store, run_available
from dipwatch.streaming.minute_job import MinuteJob
from tests.grids import NOON, frame, row


def payments(spark, cells):
    """One row per attempt; approved ones first, the others declined with code 05."""
    each = frame(spark, cells).select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "attempts")).alias("i"))
    ok = F.col("i") <= F.col("approved")
    return each.select(
        F.concat_ws("-", "minute", "provider_id", "issuer_id", "i").alias("transaction_id"),
        F.timestamp_seconds(F.col("minute") * 60 + F.col("i") % 60).alias("created_at"), "merchant_id", "provider_id", "country",
        "payment_method", "issuer_id", F.when(ok, "SUCCESS").otherwise("DECLINED").alias("status"),
        F.when(~ok, "05").alias("decline_code"), F.lit(5000).cast("bigint").alias("amount_minor"), F.lit(1000).cast("bigint").alias("amount_usd_minor"),
    )


def grid(minute, down):
    return [row(60, 6 if down and p == "adyen" and i == "itau" else 57, p, i, minute) for p in ("stripe", "adyen", "mercado_pago") for i in ("itau", "nubank")]


SHORT = [(m, 1 <= m <= 5) for m in range(13)]
HOLE = 2 * 1440
#: Backlogs beyond ten minutes, and two days without traffic while an incident is open.
LONG = [(m, 2 <= m <= 14) for m in range(15)] + [(HOLE + m, False) for m in range(3)]


@pytest.mark.parametrize("plan, parts, last, want", [
    (SHORT, [SHORT[:2], SHORT[2:5], SHORT[5:]], 12, ["opened", "updated", "updated", "resolved"]),
    (LONG, [LONG[:1], LONG[1:15], LONG[15:]], HOLE + 2, ["opened"] + ["updated"] * 10 + ["resolved"]),
])
def test_streaming_job_equals_the_batch_plan(spark, merchants, coverage, catalog, plan, parts, last, want):
    path, base = stage_path(spark, "tx"), stage_path(spark, "minute-job")
    job = MinuteJob(Store(spark, f"{base}/store"), merchants, coverage, catalog)
    for part in parts:
        tx = payments(spark, [c for m, down in part for c in grid(NOON + m, down)])
        tx.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(tx.schema).parquet(path)
        run_available(stream, f"{base}/checkpoint", job.run_batch(PAYMENT_ORDER))

    stored = spark.read.schema(tx.schema).parquet(path).where(F.col("created_at") < F.timestamp_seconds(F.lit((NOON + last) * 60)))
    rollup = stage(minute_rollup(stored).withColumn("minute", minute_of()), "r")
    declines = stage(decline_rollup(stored).withColumn("minute", minute_of()), "d")
    found = detect(rollup, merchants, coverage)
    confirmed = stage(found.signals, "s")
    shown = stage(evidence(diagnose(confirmed, rollup, declines, merchants, coverage, catalog)), "e")
    log = incident_log(shown, found.gaps, NOON, NOON + last - 1)

    def rows(df, *names):
        return sorted(tuple(r) for r in df.select(*names).collect())

    streamed = spark.read.parquet(f"{base}/store/signals")
    names = ("minute", "cell_key", "consecutive_windows", "started_minute", "attempts")
    assert rows(streamed, *names) == rows(confirmed, *names) and confirmed.count() > 0
    out = spark.read.schema(LOG_SCHEMA).parquet(f"{base}/store/incident_log")
    names = ("minute", "incident_id", "action", "request_id")
    key = lambda df: sorted(map(str, rows(df.fillna(""), *names)))
    assert key(out) == key(log)
    assert [r.action for r in log.orderBy("minute", "seq").collect()] == want
    if plan is LONG:
        return
    newest = spark.read.parquet(f"{base}/store/snapshot").where(F.col("batch_id") == 2).where("provider_id IS NULL")
    assert newest.agg(F.sum("attempts")).first()[0] == 12 * 360
    assert spark.read.parquet(f"{base}/store/pending").where(F.col("batch_id") == 2).count() == 0
