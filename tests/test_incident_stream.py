import random

from pyspark.sql import functions as F

from dipwatch.functions.cells import cell_key
from dipwatch.operators.incidents import incident_log
from dipwatch.streaming import incident_stream as S
from tests.grids import NOON
from tests.test_incidents import BR, ITAU, NUBANK, tables

MX = dict(merchant_id="MX_STORE_01", country="MX")


def streamed(spark, path, evidence, gaps, chunk_of, last, delay=30):
    """The log over files that come in the order of ``chunk_of(minute)``, at most ``delay`` minutes late."""
    ev, thin, _, _ = tables(spark, evidence, gaps, [NOON])
    stamped = lambda df: df.withColumn("bucket", F.timestamp_seconds(F.col("minute") * 60))
    rows = S.stream_rows(stamped(ev), stamped(thin)).withColumn("minute", F.unix_seconds("bucket") / 60).cache()
    chunks = {}
    for (m,) in rows.select("minute").distinct().collect():
        chunks.setdefault(chunk_of(m), []).append(m)
    for chunk in sorted(chunks):
        rows.where(F.col("minute").isin(chunks[chunk])).drop("minute").coalesce(1).write.mode("append").parquet(f"{path}/in")
    S.clock_row(spark, last + delay).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(S.ROWS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    S.run_incidents(stream, path, f"{delay} minutes")
    return spark.read.schema(S.LOG_SCHEMA).parquet(f"{path}/log")


def plain(log):
    return sorted((r.merchant_id, r.minute, r.action, r.incident_id, r.request_id, r.key) for r in log.withColumn("key", cell_key()).collect())


def test_stream_equals_batch_over_holes_and_late_files(spark, tmp_path):
    rng = random.Random(3)
    cells = [BR, ITAU, NUBANK, dict(BR, provider_id="stripe"), MX, dict(MX, payment_method="CARD")]
    # A hole of two days without any row lies in the middle.
    minutes = [*range(NOON, NOON + 80), *range(NOON + 3000, NOON + 3060)]
    evidence = [(m, rng.random(), c) for m in minutes for c in cells if rng.random() < 0.1]
    gaps = [(m, c) for m in minutes for c in cells if rng.random() < 0.15]
    last = NOON + 3070
    log = incident_log(*tables(spark, evidence, gaps, [NOON, last]))
    # Every second stretch of ten minutes comes after the next one.
    late = lambda m: (int(m) // 10 + (2 if int(m) // 10 % 2 == 0 else 0)) if m < NOON + 1000 else 10 ** 9 + int(m) // 20
    got = streamed(spark, str(tmp_path), evidence, gaps, late, last)
    assert plain(got) == plain(log) and len({a for _, _, a, *_ in plain(log)}) == 5


def test_an_incident_ends_without_further_traffic(spark, tmp_path):
    got = streamed(spark, str(tmp_path), [(NOON, 1.0, ITAU)], [], lambda m: 0, NOON + 3)
    assert [(r.minute - NOON, r.action) for r in got.orderBy("minute").collect()] == [(0, "opened"), (3, "resolved")]


def test_minutes_not_passed_by_the_watermark_are_kept(spark, tmp_path):
    got = streamed(spark, str(tmp_path), [(NOON, 1.0, ITAU), (NOON + 9, 1.0, ITAU)], [], lambda m: 0, NOON + 4)
    assert [(r.minute - NOON, r.action) for r in got.orderBy("minute").collect()] == [(0, "opened"), (3, "resolved")]
