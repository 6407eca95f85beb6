"""Sharding: minimax contiguous partition of ordered atomic groups (DataFrame functions only).

Groups are equal texts; they are ordered by a 64-bit hash of the text. Neighbouring groups in that order form at most ``SLOTS``
atoms (the leading bits of the hash), so the state of the search is bounded whatever the size of the corpus, while an atom stays
a small part of a shard. The smallest capacity under which a greedy fill needs no more than the given number of shards is found
by binary search over the atoms' sizes. Between the earliest and the latest cut that this capacity allows, the cut nearest above
the mean of what is left is taken, so that one hot group does not leave the last shards empty.

Defined results: null text has no bytes and a null checksum and forms one group of its own hash; empty tables give no rows;
repeated rows are rows of their own with the same shard; other columns are carried only where ``keep`` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from dipwatch.llm.frames import range_ranked
from dipwatch.session import stage

SHARDS = 24
SLOT_BITS = 16
ROW_BYTES = 8


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")) + F.lit(ROW_BYTES)


def _shards_needed(sizes: Column, capacity: Column) -> Column:
    def put(state: Column, size: Column) -> Column:
        fits = state["load"] + size <= capacity
        return F.struct(
            (state["shards"] + F.when(fits, F.lit(0)).otherwise(F.lit(1))).alias("shards"),
            F.when(fits, state["load"] + size).otherwise(size).alias("load"))

    first = F.struct(F.lit(1).alias("shards"), F.lit(0).cast("long").alias("load"))
    return F.aggregate(sizes, first, put, lambda s: s["shards"])


def _smallest_capacity(sizes: Column, total: Column, shards: int) -> Column:
    """Mean plus the largest atom always suffices, so the search takes as many steps as the largest atom has bits."""
    def halve(state: Column, _: Column) -> Column:
        mid = (state["lo"] + F.shiftright(state["hi"] - state["lo"], 1)).cast("long")
        fits = _shards_needed(sizes, mid) <= F.lit(shards)
        done = state["lo"] >= state["hi"]
        return F.when(done, state).otherwise(F.when(fits, F.struct(state["lo"].alias("lo"), mid.alias("hi")))
                                             .otherwise(F.struct((mid + 1).cast("long").alias("lo"), state["hi"].alias("hi"))))

    largest, mean = F.array_max(sizes), F.ceil(total / F.lit(shards)).cast("long")
    first = F.struct(F.greatest(largest, mean).alias("lo"), (largest + mean).cast("long").alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(62)), first, halve, lambda s: s["hi"])


def cut_points(atoms: DataFrame, shards: int) -> DataFrame:
    """(atom, bytes) -> (atom, shard). One row holds all atoms, at most ``2 ** SLOT_BITS`` of them."""
    upto = F.sum("bytes").over(Window.orderBy("atom"))
    row = atoms.withColumn("upto", upto).agg(F.array_sort(F.collect_list(F.struct("atom", "bytes", "upto"))).alias("a"))
    row = row.filter(F.size("a") > 0).select(
        "a", F.transform("a", lambda x: x["bytes"]).alias("sizes"), F.transform("a", lambda x: x["upto"]).alias("ends"),
        F.element_at("a", -1)["upto"].alias("total"))
    # One write keeps the optimiser from repeating the search inside every expression that uses its result.
    row = stage(row.withColumn("capacity", _smallest_capacity(F.col("sizes"), F.col("total"), shards)), "capacity")
    cap, ends, total = F.col("capacity"), F.col("ends"), F.col("total")

    def earlier(state: Column, _: Column) -> Column:
        """Least place a cut may have so that the shards after it hold the rest; grows towards the front."""
        need = F.element_at(state, 1) - cap
        least = F.when(need <= 0, F.lit(0).cast("long")).otherwise(F.array_min(F.filter(ends, lambda p: p >= need)))
        return F.concat(F.array(least), state)

    least = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), F.array(total), earlier)
    row = stage(row.withColumn("least", least), "brackets")

    def cut(state: Column, j: Column) -> Column:
        start = F.coalesce(F.element_at(state, -1), F.lit(0).cast("long"))
        ideal = start + F.ceil((total - start) / (F.lit(shards) - j)).cast("long")
        most = F.coalesce(F.array_max(F.filter(ends, lambda p: p <= start + cap)), start)
        near = F.coalesce(F.array_min(F.filter(ends, lambda p: p >= ideal)), total)
        place = F.greatest(F.least(near, most), F.element_at(F.col("least"), (j + 2).cast("int")))
        return F.concat(state, F.array(place.cast("long")))

    # The place before the first cut is 0, kept in front so that the state is never empty.
    cuts = F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), F.array(F.lit(0).cast("long")), cut)
    row = stage(row.select("a", cuts.alias("cuts")), "cuts")
    shard = F.transform("a", lambda x: F.struct(
        x["atom"].alias("atom"),
        (F.size(F.filter(F.slice("cuts", 2, shards), lambda c: c < x["upto"]))).alias("shard")))
    return row.select(F.inline(shard))


def shards(docs: DataFrame, count: int = SHARDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the columns of ``keep`` for every row of ``docs``."""
    rows = docs.select(
        "doc_id", row_size(F.col("text")).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("_hash"), *[F.col(c) for c in keep if c != "doc_id"])
    rows = stage(rows, "sized") if not keep else rows
    rows = rows.withColumn("_atom", F.shiftrightunsigned("_hash", 64 - SLOT_BITS))
    atoms = rows.groupBy(F.col("_atom").alias("atom")).agg(F.sum("size").alias("bytes"))
    placed = F.broadcast(cut_points(atoms, count).withColumnsRenamed({"atom": "_of", "shard": "_shard"}))
    rows = rows.join(placed, F.col("_atom") == F.col("_of")).drop("_of", "_atom")
    ranked = range_ranked(rows, "_shard", ["_hash", "doc_id"], "_slot")
    return ranked.select(
        "doc_id", "size", "text_crc32", *[c for c in keep if c != "doc_id"], F.col("_shard").alias("shard"),
        F.col("_slot").cast("long").alias("slot"))


def op1_minimax_shards(docs: DataFrame) -> DataFrame:
    return shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
