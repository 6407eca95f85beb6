"""Helpers shared by the operators: table reads, distributed ranks and running sums."""

from __future__ import annotations

import ctypes
import sys

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from dipwatch.session import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give freed memory of this Python process back to the system.

    The C library keeps the many small pieces that thousands of texts leave behind, and more with each run in a long session.
    """
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_ranked(df: DataFrame, key: str, order: list[str], rank: str) -> DataFrame:
    """Add ``rank``, gapless from 0 within ``key`` in ``order``, without a window over a whole key.

    Rows are range-partitioned on (key, order), so a hot key spreads over many partitions; a row's place in its partition is
    fixed by writing it. Offsets come from one row per (partition, key); as the ranges are ordered, those are at most
    partitions + keys rows, which bounds the broadcast.
    """
    ranged = df.repartitionByRange(partitions(df.sparkSession), key, *order).sortWithinPartitions(key, *order)
    ranged = stage(ranged.withColumns({
        "_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
    }), "ranked")
    blocks = ranged.groupBy("_part", F.col(key).alias("_key")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    joined = ranged.join(F.broadcast(blocks), (ranged["_part"] == blocks["_part"]) & ranged[key].eqNullSafe(blocks["_key"]))
    return joined.select(*[ranged[c] for c in df.columns], (ranged["_at"] + F.col("_base")).alias(rank))


def range_summed(df: DataFrame, key: str, order: list[str], value: str, before: str) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the rows of the same ``key`` that come earlier in ``order``.

    The running sum is made within each range partition; the partitions' totals (partitions + keys rows at most) give the offset.
    """
    ranged = stage(
        df.repartitionByRange(partitions(df.sparkSession), key, *order).withColumn("_part", F.spark_partition_id()), "summed")
    inner = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = ranged.groupBy(F.col("_part").alias("_of"), F.col(key).alias("_key")).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    running = ranged.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    joined = running.join(F.broadcast(blocks), (running["_part"] == blocks["_of"]) & running[key].eqNullSafe(blocks["_key"]))
    return joined.select(*[running[c] for c in df.columns], (F.col("_inner") + F.col("_base")).alias(before))


#: Words of 64 bits in the id filter: 2 MB at most, whatever the number of ids.
FILTER_BITS = 18


def split_by_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows that may have an id of ``ids``, rows that surely have none), without a shuffle of ``docs``.

    A bitmap over hashed ids, of bounded size, is broadcast. Callers decide exactly on the first part by a join.
    """
    def slot(h):
        return F.shiftrightunsigned(h, 64 - FILTER_BITS).cast("int")

    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    hashed = ids.select(F.xxhash64(key).alias("h"))
    words = stage(hashed.groupBy(slot(F.col("h")).alias("of")).agg(F.bit_or(bit).alias("bits")), "ids")
    # The rows are kept apart in a struct, so that no column of theirs can be taken for one of these.
    flagged = docs.select(F.struct("*").alias("row"), F.xxhash64(key).alias("h")).withColumn("at", slot(F.col("h")))
    joined = flagged.join(F.broadcast(words), F.col("at") == F.col("of"), "left").withColumn(
        "hit", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False)))
    return joined.filter("hit").select("row.*"), joined.filter("NOT hit").select("row.*")
